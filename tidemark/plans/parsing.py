"""Queries over model responses: shapes, labels, repair and prediction files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import signals as sg
from tidemark.functions.columns import once
from tidemark.functions.text import direction
from tidemark.operators import metrics
from tidemark.operators.views import with_seconds
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import P_VALUE_SQL, raw_returns, raw_sql, rounded
from tidemark.sources import predictions as pr
from tidemark.session import scratch_path

BRANDS = ["Brand#1", "Brand#2", "Brand#3"]
LABELS = [
    "bullish", "Slightly Bearish", "score: -0.75", "fairly moderately bullish", "unknown", " Strongly Bullish ",
    "n/a", "negative outlook", "about +1.25 or so", "very bearish", "significantly up", "NEUTRAL",
]
LABEL_SCORES = [1.5, -0.5, -0.75, 1.5, 0.0, 2.0, 0.0, -1.0, 1.25, -2.0, 1.5, 0.0]


def _score(brand: int) -> Column:
    return ((F.col("o_orderkey") * 7 + brand * 13) % 41 - 20).cast("double") / 10


def _label() -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("o_orderkey") % len(LABELS) + 1).cast("int"))


def _object(*pairs) -> Column:
    """JSON object text from (key, JSON text) pairs."""
    parts = []
    for key, value in pairs:
        parts += [F.lit(f'"{key}": '), value, F.lit(", ")]
    return F.concat(F.lit("{"), *parts[:-1], F.lit("}"))


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model answer per order in one of twelve shapes (``shape`` = order key modulo 12)."""
    orders = b.spread_table(spark, sf_dir, "orders", "o_orderkey").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_orderdate").cast("date").alias("date"), "o_totalprice"
    )
    text = [_score(i).cast("string") for i in (1, 2, 3)]
    quoted = [F.concat(F.lit('"'), t, F.lit('"')) for t in text]
    plain = _object(*zip(BRANDS, text))
    reason = F.lit('"because of {braces} and "')
    nested = _object(*[(n, _object(("score", t), ("reasoning", reason))) for n, t in zip(BRANDS, text)])
    label = F.concat(F.lit('"'), _label(), F.lit('"'))
    listed = F.concat(
        F.lit('[{"ticker": "Brand#1", "score": 9}, {"ticker": "Brand#1", "score": '), text[0],
        F.lit('}, {"score": 1}, "junk", {"ticker": "Brand#2"}]'),
    )
    thought = ("chain_of_thought", F.lit('"steady"'))
    shapes = [
        _object(("signal_vector", plain), thought),
        _object(("signal_vector", nested), thought),
        _object(("signal_vector", _object(("Brand#1", label), ("Brand#2", _object(("signal", label))))), thought),
        _object(("signal_vector", listed), thought),
        _object(("signals", plain)),
        _object(*zip(BRANDS, text), thought),
        _object(("signal_vector", _object(*zip(BRANDS, quoted))), thought),
        _object(("signal_vector", _object(("Brand#1", _object(("score", label)))))),
        F.concat(F.lit("```json\n"), _object(("signal_vector", plain)), F.lit("\n```\n")),
        F.concat(F.lit("<think>\nplan: {x}\n</think>\n\n Here you are: "), _object(("signal_vector", plain)), F.lit(" done")),
        F.concat(F.lit('{"chain_of_thought": "cut", "signal_vector": '), plain),
        _object(("signal_vector", _object(
            ("Brand#1", F.lit("null")), ("Brand#2", F.lit("true")), ("Brand#3", F.lit("[1]")),
        ))),
    ]
    shape = (F.col("o_orderkey") % 12).cast("int")
    return orders.withColumns({"shape": shape, "raw": F.element_at(F.array(*shapes), shape + 1)})


def response_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed responses as prediction rows."""
    rows = once(responses(spark, sf_dir), "raw", F.col("raw"))
    split = once(rows, "parts", sg.split_thinking(F.col("raw")))
    parsed = once(split, "signal", sg.parse_response(F.col("parts.content")))
    unread = F.col("signal").isNull()
    return parsed.select(
        F.col("o_orderstatus").alias("config"), F.col("o_orderkey").alias("article_idx"), "shape", "date",
        F.col("o_orderpriority").alias("source"), "raw", "signal",
        F.when(unread, "error").otherwise("success").alias("status"),
        F.when(unread, "JSON parse failed").alias("error"),
    )


SCORES_SQL = """
base AS (SELECT *, CAST(o_orderkey % 12 AS INTEGER) AS shape FROM orders),
s AS (SELECT base.*, b.b, CAST((o_orderkey * 7 + b.b * 13) % 41 - 20 AS DOUBLE) / 10 AS v
      FROM base CROSS JOIN (VALUES (1), (2), (3)) b(b))"""

NORMALISED_SQL = SCORES_SQL + """,
normal AS (
  SELECT o_orderkey AS article_idx, shape, 'Brand#' || b AS ticker, v AS score FROM s WHERE shape IN (0, 1, 5, 6, 8, 9)
  UNION ALL SELECT o_orderkey, shape, 'Brand#' || b, 0 FROM s WHERE shape = 2 AND b <= 2
  UNION ALL SELECT o_orderkey, shape, 'Brand#' || b, CASE WHEN b = 1 THEN v ELSE 0 END FROM s WHERE shape = 3 AND b <= 2
  UNION ALL SELECT o_orderkey, shape, 'signals', 0 FROM base WHERE shape = 4
  UNION ALL SELECT o_orderkey, shape, 'chain_of_thought', 0 FROM base WHERE shape = 5
  UNION ALL SELECT o_orderkey, shape, 'Brand#' || b, CASE WHEN b = 2 THEN 1 ELSE 0 END FROM s WHERE shape = 11)"""


@BOOK.add(
    "signal_normalize",
    "WITH " + NORMALISED_SQL + "\nSELECT article_idx, shape, ticker, CAST(score AS DOUBLE) AS score FROM normal",
)
def signal_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response shape as (article, ticker, score); rows with an unreadable score fail."""
    clean = sg.clean_predictions(response_predictions(spark, sf_dir))
    return sg.long_signals(pr.successful(clean), ["article_idx", "shape"])


@BOOK.add(
    "signal_normalize_loop",
    "WITH " + NORMALISED_SQL + """
SELECT article_idx, ticker, CAST(score AS DOUBLE) AS score FROM normal WHERE NOT (shape = 11 AND ticker <> 'Brand#2')""",
)
def signal_normalize_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's reading, which leaves null and list values out."""
    clean = sg.clean_predictions(response_predictions(spark, sf_dir), unknown="drop")
    return sg.long_signals(pr.successful(clean), ["article_idx"])


@BOOK.add(
    "response_status",
    """SELECT CAST(o_orderkey % 12 AS INTEGER) AS shape,
       CASE WHEN o_orderkey % 12 IN (7, 10) THEN 'error' ELSE 'success' END AS status,
       CASE WHEN o_orderkey % 12 = 7 THEN 'could not convert string to float'
            WHEN o_orderkey % 12 = 10 THEN 'JSON parse failed' END AS error, count(*) AS n FROM orders GROUP BY ALL""",
)
def response_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = sg.clean_predictions(response_predictions(spark, sf_dir))
    return clean.groupBy("shape", "status", "error").agg(F.count("*").alias("n"))


@BOOK.add(
    "truncated_response",
    "WITH " + SCORES_SQL + """
SELECT o_orderkey AS article_idx, 'Brand#' || b AS ticker, v AS score FROM s WHERE shape = 10""",
)
def truncated_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut before their last brace, closed and read."""
    cut = response_predictions(spark, sf_dir).filter("signal IS NULL")
    repaired = cut.withColumn("signal", sg.parse_truncated(F.col("raw")))
    return sg.long_signals(sg.clean_predictions(repaired.withColumn("status", F.lit("success"))), ["article_idx"])


@BOOK.add(
    "failed_responses",
    """SELECT doc_id, doc_id % 3 = 0 AS parsed, CASE WHEN doc_id % 3 <> 0 THEN 'Failed to parse JSON (output may have been truncated)' END AS served_error,
  CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS served_raw, CASE WHEN doc_id % 3 <> 0 THEN 'Qwen response was not valid JSON' END AS agent_error,
  CASE WHEN doc_id % 3 <> 0 THEN md5(text) END AS agent_raw, CASE WHEN doc_id % 3 <> 0 THEN '[]' END AS updates FROM documents""",
)
def failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as answers, two thirds of them without an object: failure records of both kinds."""
    answer = F.when(F.col("doc_id") % 3 == 0, F.lit('Sure: {"A": {"score": 1}}')).otherwise(F.col("text"))
    docs = b.table(spark, sf_dir, "documents").select("doc_id", answer.alias("raw"))
    records = docs.select(
        "doc_id", sg.served_answer(F.col("raw")).alias("served"), sg.agent_answer(F.col("raw")).alias("agent")
    )
    part = lambda column, name: F.get_json_object(column, f"$.{name}")
    return records.select(
        "doc_id", part("served", "error").isNull().alias("parsed"), part("served", "error").alias("served_error"),
        F.md5(part("served", "raw")).alias("served_raw"), part("agent", "error").alias("agent_error"),
        F.md5(part("agent", "raw_output")).alias("agent_raw"), part("agent", "memory_updates").alias("updates"),
    )


@BOOK.add(
    "thinking_split",
    """SELECT o_orderkey % 12 = 9 AS has_thinking, count(*) AS n,
       CAST(sum(CASE WHEN o_orderkey % 12 = 9 THEN length('plan: {x}') ELSE 0 END) AS BIGINT) AS thinking_chars
FROM orders GROUP BY ALL""",
)
def thinking_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = responses(spark, sf_dir).select(sg.split_thinking(F.col("raw")).alias("p"))
    return parts.groupBy((F.col("p.thinking") != "").alias("has_thinking")).agg(
        F.count("*").alias("n"), F.sum(F.length("p.thinking")).alias("thinking_chars")
    )


@BOOK.add(
    "served_signals",
    "WITH " + SCORES_SQL + """
SELECT o_orderkey AS article_idx, shape, 'Brand#' || b AS ticker FROM s
WHERE shape IN (0, 1, 4, 5, 6, 8, 9, 11) OR (shape = 2 AND b <= 2) OR (shape = 7 AND b = 1)""",
)
def served_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickers the server form stores, from the vector, ``signals`` or known top-level names."""
    rows = response_predictions(spark, sf_dir).filter("signal IS NOT NULL")
    found = rows.withColumn("e", F.explode(sg.served_entries(F.col("signal"), BRANDS)))
    return found.select("article_idx", "shape", F.col("e.ticker").alias("ticker"))


LABEL_VALUES = ", ".join(f"({i}, '{label}', {score})" for i, (label, score) in enumerate(zip(LABELS, LABEL_SCORES)))


@BOOK.add(
    "label_to_score",
    f"""WITH l(i, label, score) AS (VALUES {LABEL_VALUES})
SELECT o_orderkey AS article_idx, label, CAST(score AS DOUBLE) AS score FROM orders JOIN l ON o_orderkey % {len(LABELS)} = i""",
)
def label_to_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.spread_table(spark, sf_dir, "orders", "o_orderkey")
    return orders.select(
        F.col("o_orderkey").alias("article_idx"), _label().alias("label"), sg.word_score(_label()).alias("score")
    )


RECOVERED_SQL = "WITH " + SCORES_SQL + f""",
l(i, label, score) AS (VALUES {LABEL_VALUES}),
named AS (SELECT base.*, l.score AS label_score FROM base JOIN l ON o_orderkey % {len(LABELS)} = i),
state AS (
  SELECT o_orderkey AS article_idx, shape,
         CASE WHEN shape = 7 AND label_score <> 0 THEN 'recovered' WHEN shape IN (7, 10) THEN 'error' ELSE 'success' END AS status,
         CASE WHEN shape IN (7, 10) THEN 'error' ELSE 'success' END AS before, label_score
  FROM named)"""


@BOOK.add(
    "prediction_recovery",
    RECOVERED_SQL + """
SELECT shape, CAST(count_if(before = 'success') AS BIGINT) AS original, CAST(count_if(status = 'recovered') AS BIGINT) AS recovered,
       CAST(count_if(status = 'error') AS BIGINT) AS failed, CAST(count_if(status <> 'error') AS BIGINT) AS usable
FROM state GROUP BY shape""",
)
def prediction_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sg.clean_predictions(response_predictions(spark, sf_dir)).withColumn("before", F.col("status"))
    fixed_rows = sg.recover_predictions(stored)
    return fixed_rows.groupBy("shape").agg(*sg.recovery_counts("before", "status"))


@BOOK.add(
    "recovered_signals",
    RECOVERED_SQL + """
SELECT o_orderkey AS article_idx, 'Brand#' || b AS ticker, v AS score FROM s WHERE shape IN (0, 1, 6, 8, 9)
UNION ALL SELECT o_orderkey, 'Brand#' || b, v FROM s WHERE shape = 5
UNION ALL SELECT o_orderkey, 'chain_of_thought', 0.0 FROM base WHERE shape = 5
UNION ALL SELECT o_orderkey, 'signals', 0.0 FROM base WHERE shape = 4
UNION ALL SELECT article_idx, 'Brand#' || b.b, CAST(label_score AS DOUBLE) FROM state CROSS JOIN (VALUES (1), (2)) b(b) WHERE shape = 2
UNION ALL SELECT article_idx, 'Brand#1', CAST(label_score AS DOUBLE) FROM state WHERE shape = 7 AND label_score <> 0
UNION ALL SELECT o_orderkey, 'Brand#2', 1.0 FROM base WHERE shape = 11""",
)
def recovered_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = sg.clean_predictions(response_predictions(spark, sf_dir))
    usable = pr.usable(sg.recover_predictions(stored))
    return sg.long_signals(usable, ["article_idx"])


@BOOK.add(
    "direction_label",
    "WITH " + b.predictions_sql(b.TEN_BRANDS) + """
SELECT article_idx, ticker, CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS predicted_direction
FROM pred""",
)
def direction_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.predictions(spark, sf_dir, b.TEN_BRANDS)
    return signals.select("article_idx", "ticker", direction(F.col("score")).alias("predicted_direction"))


def written_lines(spark: SparkSession, sf_dir: str, broken: bool = True) -> str:
    """Prediction lines as files, one folder per model, with blank lines and, unless ``broken`` is
    false, broken ones among them."""
    rows = responses(spark, sf_dir)
    line = F.to_json(F.struct(
        F.when(F.col("o_orderkey") % 5 == 0, "error").otherwise("success").alias("status"),
        F.col("o_orderkey").alias("article_idx"), F.col("date").cast("string").alias("date"),
        F.concat(F.lit("Order "), F.col("o_orderkey")).alias("title"), F.col("o_orderpriority").alias("source"),
        sg.parse_span(F.col("raw")).alias("signal"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 100000).alias("time_seconds"),
        (F.col("o_totalprice") / 50).alias("time_ms"),
    ))
    extra = F.concat(F.lit("\n\n{broken "), F.col("o_orderkey")) if broken else F.lit("\n\n")
    text = F.when(F.col("o_orderkey") % 11 == 0, F.concat(line, extra)).otherwise(line)
    path = scratch_path(spark, "prediction-lines")
    rows.select(F.concat(F.lit("predictions_"), F.col("o_orderstatus")).alias("model"), text.alias("value")).write.partitionBy(
        "model"
    ).text(path)
    return path


MODEL_FILES = {"filled": "model=predictions_F", "open": "model=predictions_O", "pending": "model=predictions_P"}
MODEL_CASE = "CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'pending' END"


@BOOK.add(
    "model_list",
    f"""SELECT {MODEL_CASE} AS config, count(*) AS predictions, o_orderstatus = 'F' AS live_inference
FROM orders WHERE o_orderkey % 5 <> 0 GROUP BY o_orderstatus""",
)
def model_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files of all models in one read, broken lines skipped."""
    from tidemark.operators.views import model_list as listing

    rows = pr.read_models(spark, written_lines(spark, sf_dir), MODEL_FILES)
    return listing(pr.successful(rows), ["filled"])


@BOOK.add(
    "broken_lines",
    f"SELECT {MODEL_CASE} AS config, '{{broken ' || o_orderkey AS line FROM orders WHERE o_orderkey % 11 = 0",
)
def broken_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines on which a strict read of the prediction files fails."""
    return pr.broken_lines(spark, written_lines(spark, sf_dir), MODEL_FILES)


@BOOK.add(
    "strict_predictions",
    f"""SELECT {MODEL_CASE} AS config, o_orderkey AS article_idx, CASE WHEN o_orderkey % 5 = 0 THEN 'error' ELSE 'success' END AS status,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders""",
)
def strict_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction files without a broken line, read so that one would fail the query."""
    rows = pr.read_models(spark, written_lines(spark, sf_dir, broken=False), MODEL_FILES, strict=True)
    return rows.select("config", "article_idx", "status", "date")


@BOOK.add(
    "article_files",
    """SELECT doc_id AS article_idx, md5(source || ' ' || doc_id) AS title, md5(text) AS text,
  CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS VARCHAR) AS date, CASE WHEN doc_id % 4 <> 0 THEN source END AS source FROM documents""",
)
def article_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article lines, some without a source and with fields nobody asked for, written and read back."""
    path = scratch_path(spark, "articles")
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).cast("string")
    b.spread_table(spark, sf_dir, "documents", "doc_id").select(
        F.col("doc_id").alias("article_idx"), F.concat_ws(" ", "source", "doc_id").alias("title"), "text", day.alias("date"),
        F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("source"), F.col("n_chars").alias("other"),
    ).write.json(path)
    rows = pr.read_articles(spark, path)
    return rows.select("article_idx", F.md5("title").alias("title"), F.md5("text").alias("text"), "date", "source")


@BOOK.add(
    "run_summary",
    f"""WITH t AS (SELECT {MODEL_CASE} AS config, o_orderkey % 5 <> 0 AS ok,
  CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 50 / 1000 ELSE o_totalprice / 100000 END AS sec FROM orders)
SELECT config, count(*) AS processed, CAST(count_if(ok) AS BIGINT) AS successes, CAST(count_if(NOT ok) AS BIGINT) AS errors,
       round(sum(sec), 4) AS total_seconds, round(min(sec), 9) AS min_seconds, round(max(sec), 9) AS max_seconds,
       round(count_if(ok) / count(*), 6) AS success_rate, round(avg(sec), 6) AS avg_seconds
FROM t GROUP BY config""",
)
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pr.read_models(spark, written_lines(spark, sf_dir), MODEL_FILES)
    summary = pr.run_summary(rows, ["config"])
    summary = rounded(summary, "min_seconds", "max_seconds", digits=9)
    return rounded(rounded(summary, "success_rate", "avg_seconds"), "total_seconds", digits=4)


@BOOK.add(
    "resume_articles",
    """SELECT o_orderstatus AS config, o_orderkey AS article_idx FROM orders WHERE o_orderkey % 5 = 0""",
)
def resume_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles whose prediction is missing or failed."""
    articles = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("config"), F.col("o_orderkey").alias("article_idx")
    )
    names = {"F": "model=predictions_F", "O": "model=predictions_O", "P": "model=predictions_P"}
    return pr.remaining(articles, pr.read_models(spark, written_lines(spark, sf_dir), names))


@BOOK.add(
    "experiment_grid",
    """WITH g(config) AS (VALUES ('base_t0.5'), ('base_t0.7'), ('base_t1.0'), ('fine_tuned_t0.5'), ('fine_tuned_t0.7'), ('fine_tuned_t1.0'))
SELECT config, count(*) AS pending FROM orders CROSS JOIN g
WHERE NOT (config = 'base_t0.5' AND o_orderstatus = 'F') GROUP BY config""",
)
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to score for each model and temperature, given what one of them has done."""
    grid = [f"{m}_t{t}" for m in fixed.GRID_MODELS for t in fixed.GRID_TEMPERATURES]
    articles = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_idx"), "o_orderstatus")
    done = articles.filter("o_orderstatus = 'F'").select(
        F.lit("base_t0.5").alias("config"), "article_idx", F.lit("success").alias("status")
    )
    articles = articles.drop("o_orderstatus")
    return pr.pending_work(articles, grid, done).groupBy("config").agg(F.count("*").alias("pending"))


@BOOK.add(
    "duration_seconds",
    """SELECT o_orderkey AS article_idx, round(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 50 / 1000 ELSE o_totalprice / 100000 END, 9) AS seconds
FROM orders""",
)
def duration_seconds(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_idx"),
        F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise(F.col("o_totalprice") / 100000).alias("time_seconds"),
        (F.col("o_totalprice") / 50).alias("time_ms"),
    )
    return rounded(with_seconds(orders), "seconds", digits=9).select("article_idx", "seconds")


@BOOK.add(
    "metrics_export",
    raw_sql(b.SEVEN_BRANDS) + "," + b.SPEARMAN_SQL.format(keys="config, horizon") + "," + P_VALUE_SQL + """,
counts AS (SELECT config, count(*) AS predictions FROM pred GROUP BY config),
accuracy AS (SELECT config, CAST(count_if((score > 0) = (ret > 0)) AS BIGINT) AS correct, count(*) AS total FROM pairs WHERE horizon = 5 GROUP BY config)
SELECT config, predictions, horizon, CASE WHEN n >= 10 THEN round(rho, 6) + 0.0 END AS ic, CASE WHEN n >= 10 THEN round(p, 4) END AS p_value, n,
  round(correct / total, 6) AS accuracy, correct, total
FROM tail JOIN counts USING (config) JOIN accuracy USING (config)""",
)
def metrics_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics documents of an evaluation, written as JSON and read back with all their fields."""
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, fixed.HORIZONS)
    ic = metrics.with_significance(metrics.information_coefficient(returns, ["config", "horizon"]))
    accuracy = metrics.direction_accuracy(returns.filter("horizon = 5"), ["config"])
    path = scratch_path(spark, "metrics")
    pr.metrics_documents(ic, accuracy, b.predictions(spark, sf_dir, b.SEVEN_BRANDS)).write.json(path)
    document = F.from_json(
        "document",
        "predictions long, ic_by_horizon map<string, struct<ic: double, p_value: double, n: long>>, "
        "direction_accuracy_5d struct<accuracy: double, correct: long, total: long>",
    )
    stored = pr.read_metrics(spark, path).select("config", document.alias("document"))
    rows = stored.select("config", "document.*").select("*", F.explode("ic_by_horizon").alias("horizon", "measured"))
    values = rows.select(
        "config", "predictions", F.col("horizon").cast("int").alias("horizon"), "measured.*", "direction_accuracy_5d.*"
    )
    return rounded(rounded(values, "ic", "accuracy"), "p_value", digits=4)


@BOOK.add(
    "text_scores",
    "WITH " + b.predictions_sql(b.SEVEN_BRANDS) + """
SELECT config, count(*) AS n, round(sum(score), 4) + 0.0 AS total FROM pred WHERE article_idx % 9 <> 0 GROUP BY config""",
)
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores stored as text: read as numbers, unreadable ones skipped."""
    signals = b.predictions(spark, sf_dir, b.SEVEN_BRANDS)
    text = F.when(F.col("article_idx") % 9 == 0, "high").otherwise(F.col("score").cast("string"))
    usable = metrics.usable_rows(signals.withColumn("score", text))
    return rounded(usable.groupBy("config").agg(F.count("*").alias("n"), F.sum("score").alias("total")), "total", digits=4)
