"""The engine's relations, derived from the star-schema test tables, and the same in SQL.

Each ``*_SQL`` string is a list of common table expressions for the oracle queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators.returns import forward_returns
from tidemark.session import materialise, spread

TEN_BRANDS = list(range(1, 11))
SEVEN_BRANDS = list(range(1, 8))
FIVE_BRANDS = list(range(1, 6))
ALL_BRANDS = list(range(1, 26))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(
    spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str, task_rows: int | None = None
) -> DataFrame:
    """A table whose rows are expanded or parsed next, over all cores; only ``columns`` move. With
    ``task_rows`` a task gets about so many rows, however small their files are."""
    rows = table(spark, sf_dir, name)
    return spread(rows.select(key, *columns) if columns else rows, key, rows=task_rows)


# --- prices -----------------------------------------------------------------------------------
def unit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part, ship day and unit price of every line."""
    return table(spark, sf_dir, "lineitem").select(
        "l_partkey",
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
    )


def priced_lines(spark: SparkSession, sf_dir: str, brands: list[int] | None = None) -> DataFrame:
    """Unit prices by brand, of some brands or all; the choice is pushed into the scan of the
    parts. Parts are broadcast if their files are small; otherwise both sides are shuffled by part
    and AQE splits a part that holds much of the lines."""
    lines = unit_prices(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("ticker"))
    if brands is not None:
        parts = parts.filter(F.col("ticker").isin([f"Brand#{n}" for n in brands]))
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select("ticker", "date", "price")


def market(spark: SparkSession, sf_dir: str, brands: list[int] | None = None) -> DataFrame:
    """Price panel: ticker = brand, date = ship date, close = mean unit price."""
    return priced_lines(spark, sf_dir, brands).groupBy("ticker", "date").agg(F.avg("price").alias("close"))


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole market's mean unit price per day as one benchmark series."""
    days = unit_prices(spark, sf_dir).groupBy("date").agg(F.avg("price").alias("close"))
    return days.select(F.lit("ALL").alias("ticker"), "date", "close")


def market_panel(
    spark: SparkSession, sf_dir: str, horizons: list[int] = fixed.HORIZONS, brands: list[int] | None = None, **options
) -> DataFrame:
    """Written panel with forward returns: at most one row per ticker and calendar day."""
    return materialise(forward_returns(market(spark, sf_dir, brands), horizons, **options), "panel")


def panels(
    spark: SparkSession, sf_dir: str, brands: list[int], horizons: list[int] = fixed.HORIZONS
) -> tuple[DataFrame, DataFrame]:
    """Panels of some brands and of the benchmark, from one reading of the lines and one written
    table. Other brands fall together before the lines are summed, so the sums are a few rows a
    day, and these few are added up to the benchmark."""
    ticker = F.when(F.col("ticker").isin([f"Brand#{n}" for n in brands]), F.col("ticker"))
    sums = priced_lines(spark, sf_dir).withColumn("ticker", ticker).groupBy("ticker", "date").agg(
        F.sum("price").alias("total"), F.count("price").alias("n")
    )
    series = F.explode(F.array_compact(F.array("ticker", F.lit("ALL"))))
    close = sums.withColumn("ticker", series).groupBy("ticker", "date").agg((F.sum("total") / F.sum("n")).alias("close"))
    panel = materialise(forward_returns(close, horizons), "panels")
    return panel.filter("ticker <> 'ALL'"), panel.filter("ticker = 'ALL'")


MARKET_SQL = """
market AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""

BENCHMARK_SQL = """
bench AS (
  SELECT 'ALL' AS ticker, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close
  FROM lineitem GROUP BY 1, 2)"""


def returns_sql(source: str, name: str, horizons: list[int] = fixed.HORIZONS) -> str:
    """``name(ticker, date, horizon, ret, eff, c0)`` by row index, from a price relation."""
    values = ", ".join(f"({h})" for h in horizons)
    return f"""
{name}_idx AS (
  SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
         count(*) OVER (PARTITION BY ticker) AS cnt
  FROM {source}),
{name} AS (
  SELECT s.ticker, s.date, h.h AS horizon, (e.close - s.close) / s.close AS ret, e.i - s.i AS eff, s.close AS c0
  FROM {name}_idx s CROSS JOIN (VALUES {values}) h(h)
  JOIN {name}_idx e ON e.ticker = s.ticker AND e.i = least(s.i + h.h, s.cnt - 1)
  WHERE e.i > s.i AND s.close <> 0)"""


# --- predictions ------------------------------------------------------------------------------
#: Orders that one task expands to predictions.
TASK_ORDERS = 250_000


def predictions(spark: SparkSession, sf_dir: str, brands: list[int]) -> DataFrame:
    """One row per order and brand: config = order status, source = priority, score in [-2, 2]."""
    orders = spread_table(
        spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority", task_rows=TASK_ORDERS
    ).select(
        F.col("o_orderstatus").alias("config"),
        F.col("o_orderkey").alias("article_idx"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.col("o_orderpriority").alias("source"),
        F.explode(F.array(*[F.lit(b) for b in brands])).alias("_brand"),
    )
    score = ((F.col("article_idx") * 7 + F.col("_brand") * 13) % 41 - 20).cast("double") / 10
    return orders.select(
        "config", "article_idx", "date", "source",
        F.concat(F.lit("Brand#"), F.col("_brand")).alias("ticker"),
        score.alias("score"),
    )


def score_rows(spark: SparkSession, sf_dir: str, brands: list[int]) -> DataFrame:
    """One row per order with its ``scores``, an array of ticker and score; those of
    :func:`predictions`."""
    score = lambda n: ((F.col("o_orderkey") * 7 + n * 13) % 41 - 20).cast("double") / 10
    cells = [F.struct(F.lit(f"Brand#{n}").alias("ticker"), score(n).alias("score")) for n in brands]
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_idx"), F.array(*cells).alias("scores"))


def predictions_sql(brands: list[int], name: str = "pred") -> str:
    values = ", ".join(f"({b})" for b in brands)
    return f"""
{name} AS (
  SELECT o_orderstatus AS config, o_orderkey AS article_idx, CAST(o_orderdate AS DATE) AS date,
         o_orderpriority AS source, 'Brand#' || b.b AS ticker,
         CAST((o_orderkey * 7 + b.b * 13) % 41 - 20 AS DOUBLE) / 10 AS score
  FROM orders CROSS JOIN (VALUES {values}) b(b))"""


def variant_predictions(spark: SparkSession, sf_dir: str, brands: list[int], config: str = "model") -> DataFrame:
    """Several scores for every order, so that configurations can be compared.

    ``config='model'`` gives model0..model2, all scoring every article; ``'status'`` gives two
    variants of each order status, six configurations.
    """
    base = predictions(spark, sf_dir, brands)
    number = F.regexp_extract("ticker", r"(\d+)$", 1).cast("long")
    variants = [0, 1, 2] if config == "model" else [0, 1]
    prefix = F.lit("model") if config == "model" else F.col("config")
    return base.select("*", F.explode(F.array(*[F.lit(v) for v in variants])).alias("_variant")).select(
        F.concat(prefix, F.col("_variant")).alias("config"),
        "article_idx", "date", "source", "ticker",
        (
            ((F.col("article_idx") * 7 + number * 13 + F.col("_variant") * 17) % 41 - 20).cast("double") / 10
        ).alias("score"),
    )


def variant_predictions_sql(brands: list[int], config: str = "model", name: str = "pred") -> str:
    values = ", ".join(f"({b})" for b in brands)
    prefix, variants = ("'model'", "(0), (1), (2)") if config == "model" else ("o_orderstatus", "(0), (1)")
    return f"""
{name} AS (
  SELECT {prefix} || v.v AS config, o_orderkey AS article_idx, CAST(o_orderdate AS DATE) AS date,
         o_orderpriority AS source, 'Brand#' || b.b AS ticker,
         CAST((o_orderkey * 7 + b.b * 13 + v.v * 17) % 41 - 20 AS DOUBLE) / 10 AS score
  FROM orders CROSS JOIN (VALUES {values}) b(b) CROSS JOIN (VALUES {variants}) v(v))"""


def brand_names(brands: list[int]) -> list[str]:
    return [f"Brand#{b}" for b in brands]


# --- oracle helpers ---------------------------------------------------------------------------
SPEARMAN_SQL = """
ranked AS (
  SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score) + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS rx,
         rank() OVER (PARTITION BY {keys} ORDER BY ret) + (count(*) OVER (PARTITION BY {keys}, ret) - 1) / 2.0 AS ry
  FROM pairs),
spearman AS (
  SELECT {keys}, count(*) AS n,
         CASE WHEN min(rx) = max(rx) OR min(ry) = max(ry) THEN NULL ELSE corr(rx, ry) END AS rho
  FROM ranked GROUP BY {keys})"""


def rules_sql(source: str, keep: str = "") -> str:
    """``rules`` from ``source(family, key, correct, total)``, one CASE per column."""
    fill = lambda text: (
        "replace(replace(replace('" + text.replace("'", "''") + "', '{key}', key), '{pct}', "
        "format('{:.0f}', acc * 100)), '{n}', CAST(total AS VARCHAR))"
    )
    arms = []
    for family, fires, bound, least, rule_id, cap, category, text in fixed.RULE_FAMILIES:
        scope = f"family = 'direction' AND key = '{family}'" if family in ("bullish", "bearish") else f"family = '{family}'"
        test = f"acc >= {bound}" if fires == "at_least" else f"acc <= {bound}"
        strength = "acc" if fires == "at_least" else "1 - acc"
        arms.append((f"{scope} AND total >= {least} AND {test}", fill(rule_id), fill(text), f"least({strength}, {cap})", f"'{category}'"))
    verdict = (
        "CASE WHEN acc >= 0.55 AND acc <= 0.70 THEN 'Model is well-calibrated.' "
        "WHEN acc < 0.50 THEN 'Model tends to be overconfident.' ELSE 'Model has strong predictive power.' END"
    )
    arms.append((
        "family = 'overall' AND total >= 20", "'overall_calibration'", "replace(" + fill(fixed.OVERALL_RULE_TEXT) + ", '{verdict}', " + verdict + ")",
        "0.9", "'calibration'",
    ))
    case = lambda i: "CASE " + " ".join(f"WHEN {arm[0]} THEN {arm[i]}" for arm in arms) + " END"
    return f"""
rules AS (
  SELECT * FROM (
    SELECT {keep} {case(1)} AS rule_id, {case(2)} AS rule_text, round(CAST({case(3)} AS DOUBLE), 6) AS confidence,
           CAST(total AS BIGINT) AS evidence_count, {case(4)} AS category
    FROM (SELECT *, correct / total AS acc FROM {source}))
  WHERE rule_id IS NOT NULL)"""


def category_sql(source: str = "episodes", keep: str = "", where: str = "true") -> str:
    """``counts`` by ticker, source, direction and overall."""
    parts = [("ticker", "ticker"), ("source", "source"), ("direction", "predicted_direction"), ("overall", "'all'")]
    selects = " UNION ALL ".join(
        f"SELECT {keep} '{family}' AS family, {column} AS key, CAST(count_if(was_correct) AS BIGINT) AS correct, "
        f"count(*) AS total FROM {source} WHERE {where} GROUP BY ALL"
        for family, column in parts
    )
    return f"\ncounts AS ({selects})"


EPISODES_SQL = """
episodes AS (
  SELECT config, article_idx, date, source, ticker, score AS predicted_score, ret AS actual_return, batch,
         CASE WHEN score > 0 THEN 'bullish' ELSE 'bearish' END AS predicted_direction,
         CASE WHEN ret > 0 THEN 'bullish' ELSE 'bearish' END AS actual_direction,
         (score > 0) = (ret > 0) AS was_correct
  FROM pairs)"""
