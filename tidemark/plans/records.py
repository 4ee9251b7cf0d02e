"""Ledger queries and the streaming runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.functions.scoring import score_articles
from tidemark.operators import facts as fa
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import rounded
from tidemark.plans.facts import facts, moment
from tidemark.session import scratch_path
from tidemark.sources import ledger
from tidemark.sources.manifest import commit, committed, compact
from tidemark.streaming import fact_state, first_seen, runs

TRADE_ID = ["kind", "created_at", "strategy", "symbol", "side", "quantity", "price", "notional", "source"]


def trade_columns() -> list[Column]:
    side = F.when(F.col("l_returnflag") == "A", "BUY").when(F.col("l_returnflag") == "N", "Sell").otherwise(
        F.when(F.col("l_linenumber") % 2 == 0, "cover").otherwise("hold")
    )
    return [
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.col("l_shipdate").alias("created_at"), F.col("l_linestatus").alias("strategy"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 7).alias("symbol"), side.alias("side"),
        (F.col("l_quantity") - F.when(F.col("l_orderkey") % 13 == 0, 10).otherwise(0)).alias("quantity"),
        (F.col("l_extendedprice") - F.when(F.col("l_orderkey") % 17 == 0, 20000).otherwise(0)).alias("price"),
        F.lit("manual").alias("source"),
    ]


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as trades, some with an unknown side, no quantity or a negative price."""
    return b.table(spark, sf_dir, "lineitem").select(*trade_columns())


TRADES_SQL = """
t AS (SELECT l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS created_at, l_linestatus AS strategy, 'S' || (l_suppkey % 7) AS symbol,
        CASE WHEN l_returnflag = 'A' THEN 'buy' WHEN l_returnflag = 'N' THEN 'sell' WHEN l_linenumber % 2 = 0 THEN 'cover' ELSE 'hold' END AS side,
        l_quantity - CASE WHEN l_orderkey % 13 = 0 THEN 10 ELSE 0 END AS quantity,
        l_extendedprice - CASE WHEN l_orderkey % 17 = 0 THEN 20000 ELSE 0 END AS price FROM lineitem),
checked AS (SELECT *, quantity * price AS notional, CASE WHEN side = 'hold' THEN 'side must be one of: buy, sell, short, cover'
        WHEN quantity <= 0 THEN 'quantity must be positive' WHEN price < 0 THEN 'price must be non-negative' END AS reason FROM t)"""


def trade_totals(valid: DataFrame) -> DataFrame:
    totals = valid.groupBy("symbol", "side").agg(F.count("*").alias("n"), F.sum("notional").alias("notional"))
    return rounded(totals, "notional", digits=2)


VALID_SQL = """
SELECT symbol, side, count(*) AS n, round(sum(notional), 2) AS notional FROM checked WHERE reason IS NULL GROUP BY ALL"""


@BOOK.add("trade_ledger", "WITH " + TRADES_SQL + VALID_SQL)
def trade_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_totals(ledger.accepted(ledger.with_trade_fields(trades(spark, sf_dir)), TRADE_ID))


@BOOK.add(
    "trade_rejects",
    "WITH " + TRADES_SQL + "\nSELECT reason AS reject_reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY 1",
)
def trade_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = ledger.rejected(ledger.with_trade_fields(trades(spark, sf_dir)))
    return bad.groupBy("reject_reason").agg(F.count("*").alias("n"))


@BOOK.add(
    "ledger_list",
    "WITH " + TRADES_SQL + """
SELECT seq, created_at, symbol, side, quantity FROM checked WHERE reason IS NULL ORDER BY created_at DESC, seq DESC LIMIT 20""",
)
def ledger_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest trades: a top-k listing."""
    valid = ledger.accepted(ledger.with_trade_fields(trades(spark, sf_dir)), TRADE_ID)
    return ledger.newest_first(valid).select("seq", "created_at", "symbol", "side", "quantity")


@BOOK.add(
    "ledger_append",
    "WITH " + TRADES_SQL + """
SELECT 'trade' AS kind, count(*) AS n, count(DISTINCT (created_at, strategy, symbol, side, quantity, price)) AS ids
FROM checked WHERE reason IS NULL""",
)
def ledger_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One append per strategy, read back with their content ids."""
    path = scratch_path(spark, "ledger")
    valid = ledger.accepted(ledger.with_trade_fields(trades(spark, sf_dir)), TRADE_ID)
    for strategy in ("F", "O"):
        ledger.append_ledger(valid.filter(F.col("strategy") == strategy), path)
    stored = spark.read.schema("kind string, record_id string").json(path)
    return stored.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("record_id").alias("ids"))


@BOOK.add(
    "ledger_stored",
    "WITH " + TRADES_SQL + """
SELECT 'trade' AS kind, created_at, strategy, symbol, side, quantity, price, round(notional, 4) AS notional, 16 AS id_chars
FROM checked WHERE reason IS NULL""",
)
def ledger_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the ledger as it is read back after two appends."""
    path = scratch_path(spark, "ledger")
    valid = ledger.accepted(ledger.with_trade_fields(trades(spark, sf_dir)), TRADE_ID)
    for strategy in ("F", "O"):
        ledger.append_ledger(valid.filter(F.col("strategy") == strategy), path)
    stored = spark.read.schema(valid.schema).json(path)
    return rounded(stored.withColumn("id_chars", F.length("record_id")), "notional", digits=4).select(
        "kind", "created_at", "strategy", "symbol", "side", "quantity", "price", "notional", "id_chars"
    )


@BOOK.add(
    "eval_ledger",
    """SELECT status, reject_reason, count(*) AS n FROM (
  SELECT CASE c_custkey % 6 WHEN 0 THEN 'pass' WHEN 1 THEN 'fail' WHEN 2 THEN 'warn' WHEN 3 THEN 'skip' WHEN 4 THEN 'maybe' ELSE 'pass' END AS status,
         CASE WHEN c_custkey % 6 = 4 THEN 'status must be one of: pass, fail, warn, skip'
              WHEN c_custkey % 5 = 1 THEN 'metrics must be a JSON object' END AS reject_reason FROM customer) GROUP BY ALL""",
)
def eval_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    statuses = F.array(*[F.lit(s) for s in ["PASS", "Fail", "warn", "skip", "maybe", "pass"]])
    metrics = F.array(*[F.lit(m) for m in ['{"n": 1}', "[1]", "{}", '{"a": {"b": 2}}', None]])
    evals = b.table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.element_at(statuses, (F.col("c_custkey") % 6 + 1).cast("int")).alias("status"),
        F.element_at(metrics, (F.col("c_custkey") % 5 + 1).cast("int")).alias("metrics"),
    )
    return ledger.with_eval_fields(evals).groupBy("status", "reject_reason").agg(F.count("*").alias("n"))


@BOOK.add(
    "backtest_ledger",
    """SELECT CASE c_custkey % 4 WHEN 1 THEN 'metrics must be a JSON object' WHEN 2 THEN 'metrics must not be empty'
         WHEN 3 THEN 'metrics must be a JSON object' END AS reject_reason, count(*) AS n FROM customer GROUP BY ALL""",
)
def backtest_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = F.array(*[F.lit(m) for m in ['{"sharpe": 1.2}', "12", "{}", "{broken"]])
    backtests = b.table(spark, sf_dir, "customer").select(
        F.col("c_mktsegment").alias("strategy"), F.element_at(metrics, (F.col("c_custkey") % 4 + 1).cast("int")).alias("metrics")
    )
    return ledger.with_backtest_fields(backtests).groupBy("reject_reason").agg(F.count("*").alias("n"))


@BOOK.add(
    "ledger_collections",
    """SELECT CASE event_type WHEN 'click' THEN 'trade' WHEN 'view' THEN 'eval' WHEN 'purchase' THEN 'backtest' END AS kind,
  CASE WHEN event_type IN ('click', 'view', 'purchase') THEN NULL ELSE 'Unknown collection: ' || event_type END AS reject_reason,
  count(*) AS n FROM events GROUP BY ALL""",
)
def ledger_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("event_type") == "click", "trades").when(F.col("event_type") == "view", "evals").when(
        F.col("event_type") == "purchase", "backtests"
    ).otherwise(F.col("event_type"))
    named = b.table(spark, sf_dir, "events").select(name.alias("collection"))
    return ledger.with_collection(named).groupBy("kind", "reject_reason").agg(F.count("*").alias("n"))


# --- streaming --------------------------------------------------------------------------------
SLICES = 5
FILE_ROWS = 500_000
FILE_BYTES = 128 << 20


def row_bytes(rows: DataFrame) -> Column:
    """What a row takes: its texts, and eight bytes for each other column."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)) if kind == "string" else F.lit(8) for c, kind in rows.dtypes]
    return sum(sizes, F.lit(0).cast("long"))


def landed(rows: DataFrame, name: str, order: str) -> DataFrame:
    """``rows`` as a stream of files that arrive one after the other, in the order of a column.

    The rows are cut into slices in one pass, where they are read. The slices are then put down one
    after the other, so that the stream sees no file before those of earlier slices. A slice is the
    same number of files as any other and is read as one batch; its rows are dealt out to them one
    by one, so a file holds a bounded number of rows and bytes, however the slices fall.
    """
    spark = rows.sparkSession
    staged, path = scratch_path(spark, f"{name}-staged"), scratch_path(spark, name)
    at = F.col(order)
    if dict(rows.dtypes)[order] in ("date", "timestamp"):
        at = at.cast("timestamp").cast("long")
    shares = [k / SLICES for k in range(1, SLICES)]
    (cuts,) = rows.agg(F.percentile_approx(at, shares)).first()
    place = sum((F.when(at > cut, 1).otherwise(0) for cut in cuts or []), F.lit(0))
    rows.withColumn("_slice", place).write.partitionBy("_slice").parquet(staged)
    stored = spark.read.schema(StructType([*rows.schema.fields, StructField("_slice", IntegerType())])).parquet(staged)
    sizes = stored.groupBy("_slice").agg(F.count("*").alias("n"), F.sum(row_bytes(rows)).alias("bytes"))
    needed = F.greatest(F.ceil(F.col("n") / FILE_ROWS), F.ceil(F.col("bytes") / FILE_BYTES))
    files = sizes.agg(F.coalesce(F.max(needed), F.lit(1))).first()[0]
    empty = spark.createDataFrame([], rows.schema)
    for k in range(SLICES):
        stored.filter(F.col("_slice") == k).drop("_slice").repartition(files).write.mode("append").parquet(path)
        # A slice of few rows has fewer files, which empty ones make up for.
        for _ in range(files * (k + 1) - len(spark.read.schema(rows.schema).parquet(path).inputFiles())):
            empty.write.mode("append").parquet(path)
    return runs.file_stream(spark, path, rows.schema, files_per_trigger=files)


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "events")
    return landed(events.withColumn("ts", F.col("ts").cast("timestamp")), "event-files", "ts")


@BOOK.add("stream_dedup", "SELECT DISTINCT event_type, user_id FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = runs.deduplicated(event_stream(spark, sf_dir), ["event_type", "user_id"])
    return runs.stream_to_scratch(unique, "stream-dedup").select("event_type", "user_id")


@BOOK.add(
    "stream_first_seen",
    """SELECT event_type, user_id, ts, event_id FROM events WHERE event_id % 9 <> 0
QUALIFY row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) = 1""",
)
def stream_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, from an index of keys; repeats come in every later
    batch."""
    stream = event_stream(spark, sf_dir).filter("event_id % 9 <> 0")
    folder = scratch_path(spark, "first-seen")
    writer = first_seen.first_seen_writer(folder, ["event_type", "user_id"], ["ts", "event_id"])
    runs.run_batches(stream, writer, scratch_path(spark, "first-seen-checkpoint"))
    found = runs.batches(spark, f"{folder}/rows")
    return found.select("event_type", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id")


@BOOK.add(
    "stream_daily_counts",
    """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS events, round(avg(value), 6) AS mean_value FROM events
WHERE CAST(ts AS DATE) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL""",
)
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days the watermark has closed."""
    counts = runs.daily_counts(event_stream(spark, sf_dir), "ts", "event_type", "value")
    return rounded(runs.stream_to_scratch(counts, "stream-daily"), "mean_value")


@BOOK.add("stream_ledger", "WITH " + TRADES_SQL + VALID_SQL)
def stream_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade ledger fed by a stream; equal to the batch form."""
    stream = landed(b.table(spark, sf_dir, "lineitem"), "line-files", "l_orderkey").select(*trade_columns())
    folder = scratch_path(spark, "stream-ledger")
    runs.run_batches(stream, runs.ledger_writer(folder, TRADE_ID), scratch_path(spark, "stream-ledger-checkpoint"))
    return trade_totals(runs.batches(spark, f"{folder}/valid"))


@BOOK.add(
    "stream_outcomes",
    "WITH " + b.MARKET_SQL + """,
idx AS (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS cnt FROM market),
e AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, 'Brand#' || (o_orderkey % 25 + 1) AS ticker FROM orders),
s AS (SELECT e.*, m.date AS start_date FROM e ASOF LEFT JOIN market m ON e.ticker = m.ticker AND e.date <= m.date),
k AS (SELECT s.o_orderkey, z.date AS end_date FROM s LEFT JOIN idx a ON a.ticker = s.ticker AND a.date = s.start_date
      LEFT JOIN idx z ON z.ticker = a.ticker AND z.i = least(a.i + 5, a.cnt - 1) AND z.i > a.i)
SELECT CAST(count_if(end_date <= DATE '1999-06-30') AS BIGINT) AS known,
       CAST(count_if(end_date IS NULL OR end_date > DATE '1999-06-30') AS BIGINT) AS waiting FROM k""",
)
def stream_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals arriving as a stream, split by whether their outcome is known by a day, which
    moves on from batch to batch."""
    orders = b.table(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date"))
    signals = landed(orders, "order-files", "o_orderdate").select(
        F.col("o_orderkey").alias("article_idx"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("Brand#"), F.col("o_orderkey") % 25 + 1).alias("ticker"),
    )
    folder = scratch_path(spark, "stream-outcomes")
    until = lambda batch: F.lit(f"{min(1995 + batch, 1999)}-06-30").cast("date")
    writer = runs.outcome_writer(folder, b.market_panel(spark, sf_dir, [5]), 5, until)
    query = runs.run_batches(signals, writer, scratch_path(spark, "stream-outcomes-checkpoint"))
    known = runs.batches(spark, f"{folder}/known").select(F.lit(1).alias("known"), F.lit(0).alias("waiting"))
    last = query.lastProgress["batchId"]
    waiting = runs.open_signals(spark, folder, signals.schema, last).select(F.lit(0).alias("known"), F.lit(1).alias("waiting"))
    both = known.unionByName(waiting)
    return both.agg(F.sum("known").alias("known"), F.sum("waiting").alias("waiting"))


@BOOK.add(
    "stream_facts",
    """WITH f AS (SELECT doc_id AS id, doc_id % 200 AS created, doc_id % 200 + CASE WHEN quality = 1 AND toxic = 0 THEN 90
    WHEN quality = 0 AND toxic = 1 THEN 30 ELSE 60 END AS expires, doc_id % 3 AS reads
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT id FROM f WHERE NOT (expires < 152) AND NOT (reads = 0 AND created < 122)""",
)
def stream_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts arriving as a stream into a table that forgets; equal to the batch form."""
    stream = landed(facts(spark, sf_dir), "fact-files", "id")
    folder = scratch_path(spark, "stream-facts")
    keeper = runs.fact_keeper(folder, stream.schema)
    runs.run_batches(stream, keeper, scratch_path(spark, "stream-facts-checkpoint"))
    return runs.current_facts(spark, folder, stream.schema, moment("2024-06-01")).select("id")


READS_SQL = """
f AS (SELECT doc_id AS id, doc_id % 200 AS created, doc_id % 200 + CASE WHEN quality = 1 AND toxic = 0 THEN 90
    WHEN quality = 0 AND toxic = 1 THEN 30 ELSE 60 END AS expires, doc_id % 3 AS reads, doc_id % 200 + 5 + doc_id % 30 AS r1
  FROM documents LEFT JOIN labels USING (doc_id) WHERE doc_id % 200 <= 152),
counted AS (SELECT *, CAST(reads >= 1 AND r1 <= 152 AND r1 <= created + 30 AND r1 <= expires AS BIGINT) AS first_read FROM f),
totals AS (SELECT *, first_read + CAST(first_read = 1 AND reads = 2 AND r1 + 20 <= 152 AND r1 + 20 <= expires AS BIGINT) AS access_count FROM counted)"""


def fact_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts as they come, and up to two reads of each, until the present day."""
    stored = facts(spark, sf_dir).select("id", "created_at", "ticker", "fact_type", "content", "source", "confidence", "expires_at")
    first = F.col("created_at") + fa.days((5 + F.col("id") % 30).cast("int"))
    reads = F.slice(F.array(first, first + fa.days(20)), F.lit(1), (F.col("id") % 3).cast("int"))
    texts = ["ticker", "fact_type", "content", "source", "confidence", "expires_at"]
    used = stored.select("id", F.explode(reads).alias("at"), F.lit("read").alias("kind"), *[F.lit(None).alias(c) for c in texts])
    both = stored.select("id", F.col("created_at").alias("at"), F.lit("store").alias("kind"), *texts).unionByName(used)
    known = both.filter(F.col("at") <= moment("2024-06-01"))
    return known.withColumns({c: F.col(c).cast("timestamp") for c in ("at", "expires_at")})


@BOOK.add(
    "stream_fact_state",
    "WITH " + READS_SQL + """
SELECT id, access_count, CASE WHEN access_count > 0 THEN CAST(DATE '2024-01-01' + CAST(r1 + 20 * (access_count - 1) AS INTEGER) AS VARCHAR) END AS last_read
FROM totals WHERE expires >= 152 AND NOT (access_count = 0 AND created + 30 < 152)""",
)
def stream_fact_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts and reads arriving as a stream: access counts are state, facts leave it when they
    expire or lie idle; what stands at the end equals the batch form."""
    stream = landed(fact_changes(spark, sf_dir), "fact-changes", "at")
    folder = scratch_path(spark, "fact-versions")
    versions = fact_state.fact_versions(stream)
    runs.run_batches(
        versions, runs.batch_writer(folder), scratch_path(spark, "fact-versions-checkpoint"), "update", fact_state.STATE_STORE
    )
    standing = fact_state.standing_facts(runs.batches(spark, folder), F.lit("2024-06-01").cast("timestamp"))
    return standing.select("id", "access_count", F.col("last_accessed").cast("date").cast("string").alias("last_read"))


@BOOK.add(
    "fact_log",
    """WITH f AS (SELECT doc_id AS id, doc_id % 200 AS created, doc_id % 200 + CASE WHEN quality = 1 AND toxic = 0 THEN 90
    WHEN quality = 0 AND toxic = 1 THEN 30 ELSE 60 END AS expires, doc_id % 3 AS reads, md5(text) AS content
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT id, content FROM f WHERE NOT (expires < 152) AND NOT (reads = 0 AND created < 122)""",
)
def fact_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts appended in batches to a log that is compacted between them; what was forgotten by
    then is gone from the log, and a reader sees the facts that a single table would hold."""
    stored, folder = facts(spark, sf_dir), scratch_path(spark, "fact-log")
    read = lambda: committed(spark, folder, "facts", stored.schema).select(*stored.columns)
    for batch in range(6):
        commit({"facts": stored.filter(F.col("id") % 6 == batch)}, folder, batch)
        if batch in (2, 4):
            compact({"facts": fa.survivors(read(), moment("2024-06-01"))}, folder, batch)
    return fa.survivors(read(), moment("2024-06-01")).select("id", F.md5("content").alias("content"))


@BOOK.add(
    "scoring_hook",
    "SELECT doc_id, 'chars:' || length(text) AS response FROM documents",
)
def scoring_hook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's function over article batches."""
    articles = b.table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_articles(articles, lambda frame: "chars:" + frame["text"].str.len().astype(str))
    return scored.select("doc_id", "response")
