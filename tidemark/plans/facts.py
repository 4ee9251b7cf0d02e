"""Queries over semantic memory: facts, forgetting, access counts, contradiction, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import facts as fa
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import rounded
from tidemark.sources import dimensions


def moment(day: str) -> Column:
    return F.lit(day).cast("timestamp_ntz")


AS_OF = "2024-06-01"


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels as facts: significance from the labels sets the life time."""
    docs = b.table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").alias("content"))
    labels = b.table(spark, sf_dir, "labels")
    significance = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "high")
        .when((F.col("quality") == 0) & (F.col("toxic") == 1), "low")
        .otherwise("medium")
    )
    ttl = F.when(significance == "high", 90).when(significance == "medium", 60).otherwise(30)
    confidence = F.when(significance == "high", 1.0).when(significance == "medium", 0.7).otherwise(0.4)
    created = moment("2024-01-01") + fa.days((F.col("doc_id") % 200).cast("int"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat(F.lit("Brand#"), F.col("doc_id") % 10 + 1).alias("ticker"),
        F.col("source").alias("fact_type"), "content", "source", confidence.alias("confidence"),
        created.alias("created_at"), (created + fa.days((F.col("doc_id") % 7).cast("int"))).alias("updated_at"),
        (created + fa.days(ttl)).alias("expires_at"), (F.col("doc_id") % 3).alias("access_count"),
        F.lit(None).cast("timestamp_ntz").alias("last_accessed"),
    )


FACTS_SQL = """
facts AS (
  SELECT d.doc_id AS id, 'Brand#' || (d.doc_id % 10 + 1) AS ticker, source AS fact_type, text AS content, source,
         CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 WHEN quality = 0 AND toxic = 1 THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 200 AS INTEGER)) AS created_at,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 200 + d.doc_id % 7 AS INTEGER)) AS updated_at,
         TIMESTAMP '2024-01-01' + to_days(CAST(d.doc_id % 200 + CASE WHEN quality = 1 AND toxic = 0 THEN 90
           WHEN quality = 0 AND toxic = 1 THEN 30 ELSE 60 END AS INTEGER)) AS expires_at,
         d.doc_id % 3 AS access_count
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
fate AS (
  SELECT *, CASE WHEN expires_at < TIMESTAMP '2024-06-01' THEN 'expired'
    WHEN access_count = 0 AND created_at < TIMESTAMP '2024-05-02' THEN 'pruned' ELSE 'kept' END AS fate FROM facts),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY updated_at DESC, access_count DESC, id) AS INTEGER) AS pos
  FROM facts WHERE expires_at > TIMESTAMP '2024-06-01')"""


def fate_ids(spark: SparkSession, sf_dir: str, fate: str) -> DataFrame:
    return fa.with_fate(facts(spark, sf_dir), moment(AS_OF)).filter(F.col("fate") == fate).select("id", "expires_at")


@BOOK.add("ttl_expire", "WITH " + FACTS_SQL + "\nSELECT id, expires_at FROM fate WHERE fate = 'expired'")
def ttl_expire(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fate_ids(spark, sf_dir, "expired")


@BOOK.add("prune_unused", "WITH " + FACTS_SQL + "\nSELECT id, expires_at FROM fate WHERE fate = 'pruned'")
def prune_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fate_ids(spark, sf_dir, "pruned")


@BOOK.add(
    "forgetting_cycle",
    "WITH " + FACTS_SQL + """
SELECT CAST(count_if(fate = 'expired') AS BIGINT) AS expired, CAST(count_if(fate = 'pruned') AS BIGINT) AS pruned,
       CAST(count_if(fate = 'kept') AS BIGINT) AS kept,
       (SELECT count(*) FROM orders WHERE CAST(o_orderdate AS DATE) < DATE '2024-06-01' - 9000) AS consolidated FROM fate""",
)
def forgetting_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("article_date")
    )
    return fa.forgetting_counts(facts(spark, sf_dir), moment(AS_OF), signals, 9000)


@BOOK.add("forgetting_survivors", "WITH " + FACTS_SQL + "\nSELECT id, ticker, confidence, created_at FROM fate WHERE fate = 'kept'")
def forgetting_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.survivors(facts(spark, sf_dir), moment(AS_OF)).select("id", "ticker", "confidence", "created_at")


@BOOK.add("knowledge_topk", "WITH " + FACTS_SQL + "\nSELECT ticker, pos, id, updated_at FROM ranked WHERE pos <= 5")
def knowledge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.latest_facts(facts(spark, sf_dir), moment(AS_OF), 5).select("ticker", "pos", "id", "updated_at")


@BOOK.add(
    "knowledge_list",
    "WITH " + FACTS_SQL + """
SELECT id, ticker, fact_type, content, source, confidence, created_at FROM facts WHERE expires_at > TIMESTAMP '2024-06-01'
ORDER BY updated_at DESC, access_count DESC, id LIMIT 20""",
)
def knowledge_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest live facts: a top-k listing."""
    return fa.first_facts(facts(spark, sf_dir), moment(AS_OF), 20)


@BOOK.add(
    "access_on_read",
    "WITH " + FACTS_SQL + """
SELECT f.id, f.access_count + CASE WHEN r.id IS NULL THEN 0 ELSE 1 END AS access_count,
       CASE WHEN r.id IS NOT NULL THEN TIMESTAMP '2024-06-01' END AS last_accessed
FROM facts f LEFT JOIN (SELECT id FROM ranked WHERE pos <= 5) r ON f.id = r.id""",
)
def access_on_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading the latest facts of each ticker counts as an access to each of them."""
    known = facts(spark, sf_dir)
    log = fa.accesses(fa.latest_facts(known, moment(AS_OF), 5), moment(AS_OF))
    return fa.with_accesses(known, log).select("id", "access_count", "last_accessed")


@BOOK.add(
    "access_accounting",
    "WITH " + FACTS_SQL + """,
log AS (SELECT user_id AS fact_id, count(*) AS reads, max(ts) AS last FROM events GROUP BY 1)
SELECT id, access_count + coalesce(reads, 0) AS access_count, last AS last_accessed FROM facts LEFT JOIN log ON fact_id = id""",
)
def access_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an access log: ``user_id`` names the fact that was read."""
    log = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("fact_id"), F.col("ts").alias("at"))
    return fa.with_accesses(facts(spark, sf_dir), log).select("id", "access_count", "last_accessed")


@BOOK.add(
    "contradiction_update",
    "WITH " + FACTS_SQL + """,
updates AS (SELECT max(id) + 1000000 AS id, ticker, arg_max(content, id) AS content FROM facts GROUP BY ticker),
hit AS (SELECT r.id FROM ranked r JOIN updates u ON u.ticker = r.ticker WHERE pos <= 5 AND length(r.content) >= length(u.content) AND r.content <> u.content)
SELECT id, ticker, fact_type, confidence * CASE WHEN id IN (SELECT id FROM hit) THEN 0.5 ELSE 1 END AS confidence,
       CASE WHEN id IN (SELECT id FROM hit) THEN TIMESTAMP '2024-06-01' ELSE updated_at END AS updated_at FROM facts
UNION ALL SELECT id, ticker, 'updated_fact', 1.0, TIMESTAMP '2024-06-01' FROM updates""",
)
def contradiction_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts per ticker against its latest five, with a stand-in test for contradiction."""
    known = facts(spark, sf_dir)
    updates = known.groupBy("ticker").agg(
        (F.max("id") + 1000000).alias("id"), F.max_by("content", "id").alias("content")
    ).withColumn("source", F.lit("update"))
    clash = lambda old, new: (F.length(old) >= F.length(new)) & (old != new)
    changed = fa.apply_contradictions(known, updates, moment(AS_OF), clash)
    return changed.select("id", "ticker", "fact_type", "confidence", "updated_at")


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored signals in long form."""
    return b.predictions(spark, sf_dir, b.FIVE_BRANDS).select(
        F.col("article_idx").alias("id"), F.col("date").alias("article_date"),
        F.concat(F.lit("Order "), F.col("article_idx")).alias("article_title"), "source", "ticker", "score",
    )


OLD_SQL = "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """,
old AS (SELECT *, CAST(date_trunc('week', date) AS DATE) AS week FROM pred WHERE date < DATE '2000-01-01' - 60)"""


@BOOK.add(
    "weekly_consolidation",
    OLD_SQL + """
SELECT week, count(*) AS signals, CAST(count_if(score > 0) AS BIGINT) AS bullish, round(avg(score), 6) + 0.0 AS mean_score,
       min(article_idx) AS first_id, max(article_idx) AS last_id FROM old GROUP BY week""",
)
def weekly_consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(fa.weekly_summaries(history(spark, sf_dir), F.lit("2000-01-01").cast("date")), "mean_score")


@BOOK.add("consolidated_ids", OLD_SQL + "\nSELECT week, article_idx AS id FROM old")
def consolidated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.consolidated_ids(history(spark, sf_dir), F.lit("2000-01-01").cast("date"))


@BOOK.add(
    "signal_history_topk",
    "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """
SELECT ticker, pos, article_idx AS id, date AS article_date, score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY date DESC, article_idx) AS INTEGER) AS pos FROM pred) WHERE pos <= 20""",
)
def signal_history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fa.latest_signals(history(spark, sf_dir), 20).select("ticker", "pos", "id", "article_date", "score")


def stored_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as predictions with their reasoning, as the signal store keeps them."""
    answered = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_idx"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("source"),
        F.when(F.col("o_orderkey") % 3 != 0, F.lit('{"A": 1}')).alias("signal_vector"),
        F.concat(F.lit("because of "), F.col("o_totalprice").cast("long")).alias("reasoning"),
        F.col("o_orderstatus").alias("model_used"),
    )
    return fa.signal_headers(answered, moment(AS_OF))


@BOOK.add(
    "signal_headers",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS article_date, 'Order ' || o_orderkey AS article_title,
  o_orderpriority AS article_source, 'because of ' || CAST(trunc(o_totalprice) AS BIGINT) AS reasoning, o_orderstatus AS model_used,
  TIMESTAMP '2024-06-01' AS created_at FROM orders""",
)
def signal_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_signals(spark, sf_dir).drop("signal_vector", "was_correct")


@BOOK.add(
    "signal_listing",
    """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, 'Order ' || o_orderkey AS title, o_orderpriority AS source,
  CASE WHEN o_orderkey % 3 <> 0 THEN '{"A": 1}' ELSE '{}' END AS signal_vector, o_orderstatus AS model
FROM orders ORDER BY 2 DESC, 1 LIMIT 20""",
)
def signal_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest signals of all tickers: a top-k listing."""
    return fa.signal_listing(stored_signals(spark, sf_dir), 20)


@BOOK.add(
    "signal_store",
    "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """
SELECT ticker, CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS predicted_direction,
       count(*) AS n FROM pred GROUP BY ALL""",
)
def signal_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = fa.signal_directions(history(spark, sf_dir))
    return stored.groupBy("ticker", "predicted_direction").agg(F.count("*").alias("n"))


@BOOK.add(
    "memory_stats",
    "WITH " + FACTS_SQL + """
SELECT (SELECT count(*) FROM facts) AS knowledge_facts, count(*) AS signals_stored,
       CAST(count_if(o_orderstatus = 'F') AS BIGINT) AS correct, CAST(count_if(o_orderstatus = 'O') AS BIGINT) AS incorrect,
       CAST(count_if(o_orderstatus = 'P') AS BIGINT) AS pending,
       round(count_if(o_orderstatus = 'F') / count_if(o_orderstatus <> 'P'), 6) AS accuracy FROM orders""",
)
def memory_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    stored = b.table(spark, sf_dir, "orders").select(outcome.alias("was_correct"))
    return rounded(fa.memory_stats(facts(spark, sf_dir), stored), "accuracy")


def reasoned_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents scored for five tickers; their text is the reasoning."""
    docs = b.table(spark, sf_dir, "documents").select(
        "doc_id", "source", "text", F.explode(F.array(*[F.lit(i) for i in b.FIVE_BRANDS])).alias("_b")
    )
    return docs.select(
        (F.col("doc_id") * 10 + F.col("_b")).alias("id"), F.concat(F.lit("Brand#"), F.col("_b")).alias("ticker"),
        ((F.col("doc_id") * 7 + F.col("_b") * 13) % 41 - 20).cast("double").alias("_s"), "source",
        F.col("text").alias("reasoning"),
        # A third has no more to say about a ticker than the name of its source.
        F.when(F.col("doc_id") % 3 == 0, F.col("source")).otherwise(F.col("text")).alias("ticker_reasoning"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
    ).withColumn("score", F.col("_s") / 10).drop("_s")


REASONED_SQL = """
reasoned AS (
  SELECT doc_id * 10 + b.b AS id, 'Brand#' || b.b AS ticker, CAST((doc_id * 7 + b.b * 13) % 41 - 20 AS DOUBLE) / 10 AS score, source,
         text AS reasoning, CASE WHEN doc_id % 3 = 0 THEN source ELSE text END AS ticker_reasoning, CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS DATE) AS date
  FROM documents CROSS JOIN (VALUES (1), (2), (3), (4), (5)) b(b))"""


@BOOK.add(
    "fact_extraction",
    "WITH " + REASONED_SQL + """
SELECT 'server' AS form, id, ticker, md5('On ' || date || ': score=' || score || ' ' || ticker_reasoning) AS digest, 90 AS ttl_days
FROM reasoned WHERE length(reasoning) > 50 AND abs(score) > 0.3
UNION ALL SELECT 'own', id, ticker, md5('[' || date || '] ' || ticker_reasoning), 60
FROM reasoned WHERE length(ticker_reasoning) > 20 AND abs(score) >= 0.5
UNION ALL SELECT 'loop', id, ticker, md5('[' || date || '] Score ' || printf('%+.1f', score) || ': ' || reasoning), 60
FROM reasoned WHERE length(reasoning) > 30 AND abs(score) >= 0.5""",
)
def fact_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three forms in which facts are taken from reasoning."""
    signals = reasoned_signals(spark, sf_dir)
    forms = {
        "server": fa.reasoned_facts(signals), "own": fa.ticker_reasoning_facts(signals), "loop": fa.loop_facts(signals),
    }
    rows = [
        df.select(F.lit(form).alias("form"), "id", "ticker", F.md5("content").alias("digest"), "ttl_days")
        for form, df in forms.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@BOOK.add(
    "event_to_fact",
    """SELECT id, ticker, source_type AS fact_type, md5('[' || date || '] ' || title || ': ' || content) AS digest,
  CASE significance WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence,
  CASE significance WHEN 'high' THEN 90 WHEN 'medium' THEN 60 ELSE 30 END AS ttl_days
FROM (SELECT doc_id AS id, 'Brand#' || (doc_id % 10 + 1) AS ticker, source AS source_type,
  DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date, left(text, 40) AS title, text AS content,
  CASE doc_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS significance FROM documents)""",
)
def event_to_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("doc_id") % 3 == 0, "high").when(F.col("doc_id") % 3 == 1, "medium").otherwise("low")
    events = b.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("Brand#"), F.col("doc_id") % 10 + 1).alias("ticker"),
        F.col("source").alias("source_type"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("date"),
        F.left("text", F.lit(40)).alias("title"), F.col("text").alias("content"), level.alias("significance"),
    )
    return fa.event_facts(events).select(
        "id", "ticker", "fact_type", F.md5("content").alias("digest"), "confidence", "ttl_days"
    )


TICKER_OF_DOC = "list_extract(['IONQ','RGTI','QBTS','QUBT','QNT','IBM','GOOGL','MSFT','HON','NVDA'], doc_id % 10 + 1)"


def ticker_of_doc() -> Column:
    from tidemark import fixed_values as fixed

    return F.element_at(F.array(*[F.lit(x) for x in fixed.TICKERS]), (F.col("doc_id") % 10 + 1).cast("int"))


@BOOK.add(
    "sector_map",
    f"""WITH m(ticker, cluster, w) AS (VALUES ('IONQ','Trapped Ion',1.0), ('RGTI','Superconducting',1.0), ('QBTS','Annealing',1.0),
  ('QUBT','Neutral Atom',1.0), ('QNT','Trapped Ion',1.0), ('IBM','Superconducting',0.15), ('GOOGL','Superconducting',0.0),
  ('MSFT','Topological',0.0), ('HON','Trapped Ion',0.30), ('NVDA','Adjacent',0.0))
SELECT cluster, count(*) AS documents, round(CAST(sum(w) AS DOUBLE), 6) AS weight
FROM (SELECT {TICKER_OF_DOC} AS ticker FROM documents) JOIN m USING (ticker) GROUP BY cluster""",
)
def sector_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents per sector cluster and their weight, by the company dimension."""
    tagged = b.table(spark, sf_dir, "documents").select(ticker_of_doc().alias("ticker"))
    by_cluster = dimensions.with_sector(tagged).groupBy("cluster").agg(
        F.count("*").alias("documents"), F.sum("signal_weight").alias("weight")
    )
    return rounded(by_cluster, "weight")


@BOOK.add(
    "sector_triggers",
    """WITH t(i, up, down) AS (VALUES (0, ['IONQ','HON'], ['RGTI','IBM','GOOGL']), (1, ['RGTI','IBM','GOOGL'], ['IONQ','HON']),
  (2, ['IONQ','RGTI','HON','IBM','GOOGL','MSFT'], []), (3, ['IONQ','RGTI','QBTS','QUBT','IBM','HON'], [])),
e AS (SELECT i, unnest(up) AS ticker, 1 AS effect FROM t UNION ALL SELECT i, unnest(down), -1 FROM t)
SELECT ticker, count(*) AS events, CAST(sum(effect) AS BIGINT) AS net_effect FROM documents JOIN e ON doc_id % 4 = i GROUP BY ticker""",
)
def sector_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net effect of trigger events per ticker; every document is one trigger event."""
    from tidemark import fixed_values as fixed

    names = F.array(*[F.lit(row[0]) for row in fixed.SECTOR_TRIGGERS])
    events = b.table(spark, sf_dir, "documents").select(
        F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("trigger")
    )
    effects = events.join(F.broadcast(dimensions.sector_triggers(spark)), "trigger")
    return effects.groupBy("ticker").agg(
        F.count("*").alias("events"), F.sum("effect").alias("net_effect")
    )


@BOOK.add(
    "company_lookup",
    f"""WITH c(ticker, name, cik) AS (VALUES ('IONQ','IonQ','0001812364'), ('RGTI','Rigetti','0001838359'), ('QBTS','D-Wave','0001907982'),
  ('QUBT','Quantum Computing Inc','0001758009'), ('QNT','Quantinuum',''), ('IBM','IBM','0000051143'), ('GOOGL','Google','0001652044'),
  ('MSFT','Microsoft','0000789019'), ('HON','Honeywell','0000773840'), ('NVDA','NVIDIA','0001045810'))
SELECT doc_id, ticker, name, cik AS sec_cik FROM (SELECT doc_id, {TICKER_OF_DOC} AS ticker FROM documents) JOIN c USING (ticker)""",
)
def company_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = b.table(spark, sf_dir, "documents").select("doc_id", ticker_of_doc().alias("ticker"))
    return dimensions.with_company(tagged).select("doc_id", "ticker", "name", "sec_cik")


@BOOK.add(
    "seed_load",
    "WITH " + FACTS_SQL + """,
seeded AS (SELECT fact_type FROM facts UNION ALL SELECT unnest(['technology','roadmap','technology','roadmap','technology','competitive',
  'technology','milestone','technology','exposure','competitive','competitive']))
SELECT fact_type, count(*) AS n FROM seeded GROUP BY 1""",
)
def seed_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seed facts appended to the stored ones."""
    seeds = dimensions.seed_facts(spark).withColumn("id", -F.monotonically_increasing_id() - 1)
    added = fa.new_facts(seeds, moment(AS_OF))
    stored = facts(spark, sf_dir).select(*fa.FACT_FIELDS).unionByName(added.select(*fa.FACT_FIELDS))
    return stored.groupBy("fact_type").agg(F.count("*").alias("n"))
