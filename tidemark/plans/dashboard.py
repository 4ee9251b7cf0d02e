"""Queries behind the dashboard: price files, windows, indexes, cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import views
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import rounded
from tidemark.session import materialise, scratch_path
from tidemark.sources import market as mk


@BOOK.add(
    "market_files",
    "WITH " + b.MARKET_SQL + """
SELECT 'B' || replace(ticker, 'Brand#', '') AS ticker, count(*) AS n, min(date) AS first, max(date) AS last, round(sum(close), 2) AS total
FROM market WHERE NOT (CAST(replace(ticker, 'Brand#', '') AS INTEGER) % 2 = 0 AND day(date) = 1) GROUP BY 1""",
)
def market_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price files per ticker, half with adjusted closes (some missing), read as one panel."""
    path = scratch_path(spark, "market-files")
    number = F.regexp_extract("ticker", r"(\d+)$", 1)
    prices = materialise(
        b.market(spark, sf_dir).select(F.concat(F.lit("B"), number).alias("name"), F.col("date").alias("Date"), "close"),
        "prices",
    )
    even = F.regexp_extract("name", r"(\d+)$", 1).cast("int") % 2 == 0
    adjusted = prices.filter(even).select(
        "name", "Date", (F.col("close") + 1).alias("Close"),
        F.when(F.dayofmonth("Date") != 1, F.col("close")).alias("Adj Close"),
    )
    plain = prices.filter(~even).select("name", "Date", F.col("close").alias("Close"))
    adjusted.repartition("name").write.partitionBy("name").parquet(f"{path}/adjusted")
    plain.repartition("name").write.partitionBy("name").parquet(f"{path}/plain")
    panel = mk.read_market(spark, path)
    return rounded(panel.groupBy("ticker").agg(
        F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum("close").alias("total")
    ), "total", digits=2)


@BOOK.add(
    "price_range",
    "WITH " + b.MARKET_SQL + """
SELECT ticker, date, round(close + 1e-9, 6) AS close FROM market
WHERE ticker = 'Brand#7' AND date BETWEEN DATE '1996-03-01' AND DATE '1999-03-31'""",
)
def price_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mk.price_range(b.market(spark, sf_dir), "Brand#7", "1996-03-01", "1999-03-31")
    return rounded(found.withColumn("close", F.col("close") + 1e-9), "close")


@BOOK.add(
    "market_display",
    "WITH " + b.MARKET_SQL + "\nSELECT ticker, count(*) AS n, round(avg(round(close, 2)), 1) AS mean_close FROM market GROUP BY 1",
)
def market_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = mk.for_display(b.market(spark, sf_dir))
    return rounded(shown.groupBy("ticker").agg(F.count("*").alias("n"), F.avg("close").alias("mean_close")), "mean_close", digits=1)


@BOOK.add(
    "event_price_window",
    "WITH " + b.MARKET_SQL + """,
w AS (SELECT ticker, date, count(*) OVER f AS n, last_value(date) OVER f AS last, min(close) OVER f AS low, max(close) OVER f AS high
      FROM market WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING)),
e AS (SELECT o_orderkey AS article_idx, CAST(o_orderdate AS DATE) AS date, 'Brand#' || (o_orderkey % 25 + 1) AS ticker FROM orders)
SELECT e.article_idx, e.ticker, w.date AS start_date, w.last AS last_date, CAST(w.n AS INTEGER) AS n_rows, round(w.low + 1e-9, 6) AS low, round(w.high + 1e-9, 6) AS high
FROM e ASOF JOIN w ON e.ticker = w.ticker AND e.date <= w.date""",
)
def event_price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_idx"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("Brand#"), F.col("o_orderkey") % 25 + 1).alias("ticker"),
    )
    windows = materialise(views.price_windows(b.market(spark, sf_dir)), "windows")
    found = views.event_price_windows(events, windows)
    return rounded(found.select(
        "article_idx", "ticker", "start_date", F.element_at("dates", -1).alias("last_date"),
        F.size("closes").alias("n_rows"),
        # The shift keeps exact halves off the rounding boundary, where engines differ.
        (F.array_min("closes") + 1e-9).alias("low"), (F.array_max("closes") + 1e-9).alias("high"),
    ), "low", "high")


@BOOK.add(
    "event_price_rows",
    "WITH " + b.MARKET_SQL + """,
idx AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM market),
e AS (SELECT o_orderkey AS article_idx, CAST(o_orderdate AS DATE) AS date, 'Brand#' || (o_orderkey % 25 + 1) AS ticker FROM orders WHERE o_orderpriority = '1-URGENT'),
s AS (SELECT e.article_idx, e.ticker, x.date AS start_date, x.i FROM e ASOF JOIN idx x ON e.ticker = x.ticker AND e.date <= x.date)
SELECT article_idx, s.ticker, start_date, CAST(p.i - s.i AS INTEGER) AS place, p.date AS price_date, round(p.close + 1e-9, 6) AS close
FROM s JOIN idx p ON p.ticker = s.ticker AND p.i BETWEEN s.i AND s.i + 20""",
)
def event_price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prices after each urgent event, a row each: what a chart shows."""
    events = b.table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(
        F.col("o_orderkey").alias("article_idx"), F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.lit("Brand#"), F.col("o_orderkey") % 25 + 1).alias("ticker"),
    )
    found = views.window_rows(events, b.market(spark, sf_dir)).drop("date")
    return rounded(found.withColumn("close", F.col("close") + 1e-9), "close")


@BOOK.add(
    "benchmark_window",
    "WITH " + b.BENCHMARK_SQL + """,
w AS (SELECT date, count(*) OVER f AS n, last_value(date) OVER f AS last
      FROM bench WINDOW f AS (ORDER BY date ROWS BETWEEN CURRENT ROW AND 20 FOLLOWING))
SELECT o_orderkey AS article_idx, w.date AS start_date, w.last AS last_date, CAST(w.n AS INTEGER) AS n_rows
FROM orders ASOF JOIN w ON CAST(o_orderdate AS DATE) <= w.date""",
)
def benchmark_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's window after every event."""
    events = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("article_idx"), F.col("o_orderdate").cast("date").alias("date"), F.lit("ALL").alias("ticker")
    )
    windows = materialise(views.price_windows(b.benchmark(spark, sf_dir)), "windows")
    return views.event_price_windows(events, windows).select(
        "article_idx", "start_date", F.element_at("dates", -1).alias("last_date"), F.size("closes").alias("n_rows")
    )


@BOOK.add(
    "prediction_index",
    """SELECT o_orderstatus AS config, o_orderkey AS article_idx,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders""",
)
def prediction_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = b.table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("config"), F.col("o_orderkey").alias("article_idx"),
        F.col("o_orderdate").cast("date").alias("date"),
    )
    return views.prediction_index(rows).select("config", "article_idx", "idx")


CARD_SQL = """
SELECT article_idx, ticker, score, round(abs(score) / greatest(max(abs(score)) OVER (PARTITION BY article_idx), 1) * 100, 6) AS width
FROM pred"""


@BOOK.add("signal_card", "WITH " + b.predictions_sql(b.FIVE_BRANDS) + "\nSELECT * FROM (" + CARD_SQL + ") WHERE abs(score) > 0.01")
def signal_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.signal_card(b.score_rows(spark, sf_dir, b.FIVE_BRANDS), ["article_idx"]), "width")


@BOOK.add("signal_compare", "WITH " + b.predictions_sql(b.FIVE_BRANDS) + CARD_SQL)
def signal_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.signal_card(b.score_rows(spark, sf_dir, b.FIVE_BRANDS), ["article_idx"], least=None), "width")


@BOOK.add(
    "signal_chips",
    "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """
SELECT article_idx, string_agg(ticker || ' ' || printf('%+.1f', score), ', ' ORDER BY ticker) AS chips
FROM pred WHERE abs(score) >= 0.05 GROUP BY article_idx""",
)
def signal_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.signal_chips(b.score_rows(spark, sf_dir, b.FIVE_BRANDS), ["article_idx"])


@BOOK.add(
    "model_comparison",
    "WITH " + b.variant_predictions_sql([1, 2]) + """
SELECT article_idx, ticker, max(CASE WHEN config = 'model0' THEN score END) AS model0,
       max(CASE WHEN config = 'model1' THEN score END) AS model1, max(CASE WHEN config = 'model2' THEN score END) AS model2
FROM pred GROUP BY ALL""",
)
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.variant_predictions(spark, sf_dir, [1, 2])
    return views.compare_models(signals, ["model0", "model1", "model2"], keys=["article_idx", "ticker"])


@BOOK.add(
    "article_models",
    """WITH lines AS (
  SELECT 'model' || v.v AS config, o_orderkey AS article_idx, CAST(o_orderdate AS DATE) - CAST(r.r AS INTEGER) % 2 AS date, r.r AS place,
    '{"A":' || (o_orderkey % 7 + r.r) || '}' AS signal,
    CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice / 50 / 1000 ELSE (o_totalprice + r.r) / 100000 END AS seconds
  FROM orders CROSS JOIN (VALUES (0), (1), (2)) v(v) CROSS JOIN (VALUES (0), (1), (2)) r(r)
  WHERE (o_orderkey + v.v) % 5 <> 0 AND (r.r = 0 OR o_orderkey % 4 = 0)),
firsts AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY config, article_idx ORDER BY date, place) = 1)
SELECT article_idx, max(signal) FILTER (config = 'model0') AS model0_signal, max(signal) FILTER (config = 'model1') AS model1_signal,
  max(signal) FILTER (config = 'model2') AS model2_signal, round(max(seconds) FILTER (config = 'model0'), 9) AS model0_seconds,
  round(max(seconds) FILTER (config = 'model1'), 9) AS model1_seconds, round(max(seconds) FILTER (config = 'model2'), 9) AS model2_seconds
FROM firsts GROUP BY article_idx""",
)
def article_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prediction of every model for an article, with its signal and duration; a quarter
    of the articles have two further rows per model, one of them of an earlier day."""
    models = F.explode(F.array(*[F.lit(v) for v in range(3)]))
    repeats = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))
    rows = b.table(spark, sf_dir, "orders").select("*", models.alias("v")).select("*", F.explode(repeats).alias("place"))
    rows = rows.filter((F.col("o_orderkey") + F.col("v")) % 5 != 0)
    timed = F.when(F.col("o_orderkey") % 3 == 0, F.lit(0.0)).otherwise((F.col("o_totalprice") + F.col("place")) / 100000)
    lines = rows.select(
        F.concat(F.lit("model"), "v").alias("config"), F.col("o_orderkey").alias("article_idx"),
        F.date_sub(F.col("o_orderdate").cast("date"), F.col("place") % 2).alias("date"), "place",
        F.concat(F.lit('{"A":'), F.col("o_orderkey") % 7 + F.col("place"), F.lit("}")).alias("signal"),
        timed.alias("time_seconds"), (F.col("o_totalprice") / 50).alias("time_ms"),
    )
    names = ["model0", "model1", "model2"]
    found = views.first_predictions(views.with_seconds(lines), names, ["date", "place"])
    return rounded(found, *[f"{name}_seconds" for name in names], digits=9)


@BOOK.add(
    "tickers_found",
    "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """
SELECT article_idx, count(*) AS tickers_found, max(score) AS top_score FROM pred WHERE score <> 0 GROUP BY article_idx""",
)
def tickers_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.tickers_found(b.score_rows(spark, sf_dir, b.FIVE_BRANDS), ["article_idx"])
