"""Queries over the composed cycles: feed ingestion, feedback loop, reasoning words, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ingestion as ing
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import rounded
from tidemark.plans.contexts import semantic, semantic_sql, with_tickers
from tidemark.plans.feeds import ITEMS_SQL, items, rss
from tidemark.plans.learning import EPISODE_CTES
from tidemark.plans.parsing import MODEL_FILES, written_lines
from tidemark.schemas import RULES
from tidemark.session import materialise, scratch_path
from tidemark.sources import feeds
from tidemark.sources import predictions as pr
from tidemark.sources.manifest import commit, committed


AS_OF = "2024-12-31"
# Recorded answers: their kind follows from the title.
KIND_SQL = "strpos('0123456789abcdef', substr(md5(title), 1, 1)) % 4"
ANSWERS = [
    'Here: {{"signal_vector": {{"Brand#1": 1.5, "Brand#2": {{"score": -0.4}}, "Brand#3": null}}, "chain_of_thought": "read {0}"}} done',
    '{{"chain_of_thought": "no vector in {0}"}}',
    "nothing to say about {0}",
    '{{"signal_vector": {{"Brand#4": 0.05}}}}',
]

INGESTED_SQL = (
    ITEMS_SQL + f""",
items AS (SELECT doc_id * 1048576 AS seq, source, trim(title || ' hiring') AS title, body AS description, published FROM p
  UNION ALL SELECT doc_id * 1048576 + 1, source, trim('<b>' || replace(title, ']]>', '') || '</b> layoff'), '', published FROM p),
fresh AS (SELECT *, {KIND_SQL} AS kind FROM items WHERE title NOT IN (SELECT trim(title || ' hiring') FROM d WHERE source < 'src13')
  QUALIFY row_number() OVER (PARTITION BY title ORDER BY seq) = 1)"""
).replace("""FROM documents)""", f"""FROM documents),
p AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN 'soon' ELSE 'Mon, ' || strftime(day, '%d %b %Y') || ' 23:30:00 '
  || CASE WHEN doc_id % 2 = 0 THEN 'GMT' ELSE '-0500' END END AS published FROM d)""", 1)


@BOOK.add(
    "feed_ingestion",
    "WITH " + INGESTED_SQL + "," + semantic_sql("SELECT seq AS query_id, source, title || '. ' || description AS text FROM fresh") + """,
stored AS (SELECT *, CASE kind WHEN 0 THEN '{"Brand#1":1.5,"Brand#2":{"score":-0.4},"Brand#3":null}' ELSE '{"Brand#4":0.05}' END AS signal_vector,
    CASE kind WHEN 0 THEN 'read ' || md5(title) ELSE '' END AS reasoning,
    CASE kind WHEN 0 THEN [{t: 'Brand#1', d: 'bullish'}, {t: 'Brand#2', d: 'bearish'}, {t: 'Brand#3', d: 'neutral'}]
      ELSE [{t: 'Brand#4', d: 'neutral'}] END AS directions FROM fresh WHERE kind IN (0, 3))
SELECT seq AS id, source AS article_source, published AS article_date, md5(title) AS title, md5(packed) AS context, signal_vector, reasoning,
  'recorded' AS model_used, e.t AS ticker, e.d AS predicted_direction
FROM stored JOIN semantic ON query_id = seq, (SELECT unnest(directions) AS e) u""",
)
def feed_ingestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RSS payloads to stored signals, with the context each article was asked with. The turn is
    committed twice, as a batch that runs again would be, and read back once."""
    tables, folder = ingested(spark, sf_dir), scratch_path(spark, "ingested")
    for _ in range(2):
        commit(tables, folder, 0)
    read = lambda name: committed(spark, folder, name, tables[name].schema)
    asked = read("asked").select(F.col("seq").alias("id"), F.md5("context").alias("context"))
    signals = read("signals").join(asked, "id")
    return signals.select(
        "id", "article_source", "article_date", F.md5("article_title").alias("title"), "context", "signal_vector", "reasoning",
        "model_used", F.explode("predicted_direction").alias("ticker", "predicted_direction"),
    )


def ingested(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = items(spark, sf_dir)
    history = rows.filter("source < 'src13'").select(F.trim(F.concat("title", F.lit(" hiring"))).alias("article_title"))
    payloads = rss(rows).select(F.col("doc_id").alias("seq"), "source", "payload")
    titles = feeds.rss_articles(payloads).select("title").distinct()
    kind = F.expr(KIND_SQL.replace("strpos", "instr"))
    response = F.element_at(F.array(*[F.format_string(text.format("%1$s"), F.md5("title")) for text in ANSWERS]), kind + 1)
    answers = titles.withColumn("response", response)
    retrieve = lambda asked: semantic(spark, sf_dir, materialise(with_tickers(asked), "asked"))
    moment = F.lit(AS_OF).cast("date")
    return ing.ingestion_cycle(payloads, history, retrieve, ing.recorded_answers(answers), moment, "recorded")


@BOOK.add(
    "ingestion_counts",
    "WITH " + INGESTED_SQL + """
SELECT (SELECT count(*) FROM items) AS articles_fetched, CAST(count_if(kind IN (0, 3)) AS BIGINT) AS signals_generated FROM fresh""",
)
def ingestion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ing.cycle_counts(ingested(spark, sf_dir))


@BOOK.add(
    "feedback_loop",
    EPISODE_CTES + "," + b.category_sql() + "," + b.rules_sql("counts") + """
SELECT (SELECT count(*) FROM episodes) AS outcomes_recorded,
       (SELECT count(*) FROM rules) AS rules_generated, (SELECT count(*) + 1 FROM rules WHERE confidence >= 0.5) AS active_rules""",
)
def feedback_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One turn over all signals, on a store that holds one older rule."""
    turn = feedback_turn(spark, sf_dir)
    count = lambda name: turn[name].agg(F.count("*")).scalar()
    return turn["episodes"].agg(F.count("*").alias("outcomes_recorded")).withColumns(
        {"rules_generated": count("new_rules"), "active_rules": count("active_rules")}
    )


def feedback_turn(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS)
    moment = F.lit("2002-01-01").cast("timestamp")
    stored = spark.createDataFrame([("older", "An older rule.", 0.7, 10, "pattern")], (
        "rule_id string, rule_text string, confidence double, evidence_count long, category string"
    )).withColumns({"created_at": moment, "last_validated": moment})
    names = [field.split()[0] for field in RULES.split(", ")]
    return ing.feedback_loop(signals, b.market_panel(spark, sf_dir, [5]), stored.select(*names), moment)


@BOOK.add(
    "feedback_outcomes",
    EPISODE_CTES + """
SELECT article_idx, date, source, ticker, predicted_score, predicted_direction, actual_direction, was_correct, round(actual_return, 6) + 0.0 AS actual_return
FROM episodes""",
)
def feedback_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcomes that a turn of the loop records, row by row."""
    recorded = feedback_turn(spark, sf_dir)["episodes"]
    return rounded(recorded, "actual_return").select(
        "article_idx", "date", "source", "ticker", "predicted_score", "predicted_direction", "actual_direction", "was_correct", "actual_return"
    )


@BOOK.add(
    "feedback_rules",
    EPISODE_CTES + "," + b.category_sql() + "," + b.rules_sql("counts") + """
SELECT rule_id, rule_text, confidence, evidence_count, category FROM rules WHERE confidence >= 0.5
UNION ALL SELECT 'older', 'An older rule.', 0.7, 10, 'pattern'""",
)
def feedback_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules that hold after a turn of the loop."""
    rules = rounded(feedback_turn(spark, sf_dir)["active_rules"], "confidence")
    return rules.select("rule_id", "rule_text", "confidence", "evidence_count", "category")


UP_WORDS, DOWN_WORDS = ["the", "les", "que"], ["of", "der", "und"]


@BOOK.add(
    "reasoning_words",
    """WITH w AS (SELECT source, regexp_extract_all(lower(text), '[a-z]+') AS toks FROM documents)
SELECT source, CAST(sum(len(list_filter(toks, lambda x: x IN ('the', 'les', 'que')))) AS BIGINT) AS bullish,
       CAST(sum(len(list_filter(toks, lambda x: x IN ('of', 'der', 'und')))) AS BIGINT) AS bearish FROM w GROUP BY source""",
)
def reasoning_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.spread_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return ing.lexicon_counts(texts, ["source"], {"bullish": UP_WORDS, "bearish": DOWN_WORDS}, "text")


@BOOK.add(
    "served_predictions",
    """SELECT CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'pending' END AS config, o_orderkey AS article_idx,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, 'Order ' || o_orderkey AS title, o_orderpriority AS source
FROM orders WHERE o_orderkey % 5 <> 0""",
)
def served_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files as the event listing serves them, in date order."""
    rows = pr.read_models(spark, written_lines(spark, sf_dir), MODEL_FILES)
    return pr.served(rows).select("config", "article_idx", "date", "title", "source")
