"""Evaluation queries: returns, information coefficient, direction accuracy and their reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators import metrics
from tidemark.operators.returns import forward_returns, join_abnormal, join_as_of, scan_as_of
from tidemark.operators.rules import batch_of
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.session import materialise

PAIRS_SQL = """
pairs AS (
  SELECT p.config, p.article_idx, p.date, p.source, p.ticker, p.score, r.horizon, r.ret,
         p.article_idx // 50 AS batch
  FROM (SELECT p.*, m.date AS start_date FROM pred p ASOF JOIN market m
        ON p.ticker = m.ticker AND p.date <= m.date) p
  JOIN ret r ON r.ticker = p.ticker AND r.date = p.start_date
  WHERE {where})"""

ABNORMAL_PAIRS_SQL = """
pairs AS (
  SELECT p.config, p.article_idx, p.ticker, p.score, r.horizon, r.ret - br.ret AS ret
  FROM (SELECT p.*, m.date AS start_date FROM pred p ASOF JOIN market m
        ON p.ticker = m.ticker AND p.date <= m.date) p
  JOIN ret r ON r.ticker = p.ticker AND r.date = p.start_date
  JOIN (SELECT p.config, p.article_idx, p.ticker, bb.date AS bench_start FROM pred p ASOF JOIN bench bb
        ON p.date <= bb.date) pb
    ON pb.config = p.config AND pb.article_idx = p.article_idx AND pb.ticker = p.ticker
  JOIN bret br ON br.date = pb.bench_start AND br.horizon = r.horizon
  WHERE {where})"""


def raw_sql(
    brands: list[int], where: str = "abs(p.score) >= 0.3", horizons=fixed.HORIZONS, variants: str | None = None
) -> str:
    pred = b.variant_predictions_sql(brands, variants) if variants else b.predictions_sql(brands)
    return "WITH " + ",".join(
        [b.MARKET_SQL, b.returns_sql("market", "ret", horizons), pred, PAIRS_SQL.format(where=where)]
    )


def abnormal_sql(brands: list[int], where: str, horizons) -> str:
    return "WITH " + ",".join([
        b.MARKET_SQL, b.BENCHMARK_SQL, b.returns_sql("market", "ret", horizons),
        b.returns_sql("bench", "bret", horizons), b.predictions_sql(brands), ABNORMAL_PAIRS_SQL.format(where=where),
    ])


def raw_returns(
    spark: SparkSession, sf_dir: str, brands: list[int], horizons: list[int], keys=("config",),
    variants: str | None = None,
) -> DataFrame:
    if variants:
        signals = b.variant_predictions(spark, sf_dir, brands, variants)
    else:
        signals = b.predictions(spark, sf_dir, brands)
    signals = metrics.conviction(signals).withColumn("batch", batch_of(F.col("article_idx")))
    panel = b.market_panel(spark, sf_dir, horizons, brands)
    return metrics.signal_returns(signals, panel, horizons, list(keys))


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@BOOK.add(
    "ic_by_config_horizon",
    raw_sql(b.SEVEN_BRANDS) + "," + b.SPEARMAN_SQL.format(keys="config, horizon") + """
SELECT config, horizon, CASE WHEN n >= 10 THEN round(rho, 6) + 0.0 END AS ic, n FROM spearman""",
)
def ic_by_config_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, fixed.HORIZONS)
    ic = metrics.information_coefficient(returns, ["config", "horizon"])
    return rounded(ic, "ic").select("config", "horizon", "ic", "n")


P_VALUE_SQL = """
stat AS (SELECT *, n - 2 AS df, atan(abs(rho) / sqrt(1 - rho * rho)) AS theta FROM spearman),
-- two-sided Student-t tail as an integral of a power of cosine, by Simpson's rule
tail AS (
  SELECT *, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(pi()) * theta / 4000 / 3 * list_sum(
    list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
      * pow(cos(theta * i / 4000), df - 1))) AS p
  FROM stat)"""


@BOOK.add(
    "ic_significance",
    raw_sql(b.SEVEN_BRANDS) + "," + b.SPEARMAN_SQL.format(keys="config, horizon") + "," + P_VALUE_SQL + """
SELECT config, horizon, round(rho, 4) + 0.0 AS ic, round(p, 4) AS p_value, n,
       CASE WHEN p < 0.01 THEN '***' WHEN p < 0.05 THEN '**' WHEN p < 0.10 THEN '*' ELSE '' END AS stars,
       p < 0.05 AS significant
FROM tail WHERE n >= 10""",
)
def ic_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, fixed.HORIZONS)
    ic = metrics.information_coefficient(returns, ["config", "horizon"]).filter("ic IS NOT NULL")
    return rounded(metrics.with_significance(ic), "ic", "p_value", digits=4).select(
        "config", "horizon", "ic", "p_value", "n", "stars", "significant"
    )


@BOOK.add(
    "abnormal_ic",
    abnormal_sql(b.FIVE_BRANDS, "p.score <> 0", fixed.HORIZONS) + ","
    + b.SPEARMAN_SQL.format(keys="config, horizon") + """
SELECT config, horizon, CASE WHEN n >= 20 THEN round(rho, 6) + 0.0 END AS ic, n FROM spearman""",
)
def abnormal_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS).filter("score <> 0")
    panel, bench = b.panels(spark, sf_dir, b.FIVE_BRANDS)
    returns = metrics.signal_returns(signals, panel, fixed.HORIZONS, ["config"], bench)
    ic = metrics.information_coefficient(returns, ["config", "horizon"], fixed.MIN_PAIRS_ABNORMAL)
    return rounded(ic, "ic").select("config", "horizon", "ic", "n")


@BOOK.add(
    "direction_accuracy",
    raw_sql(b.SEVEN_BRANDS, horizons=[5]) + """
SELECT config, CAST(count_if((score > 0) = (ret > 0)) AS BIGINT) AS correct, count(*) AS total,
       round(count_if((score > 0) = (ret > 0)) / count(*), 6) AS accuracy
FROM pairs GROUP BY config""",
)
def direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, [5])
    return rounded(metrics.direction_accuracy(returns, ["config"]), "accuracy")


@BOOK.add(
    "abnormal_direction_accuracy",
    abnormal_sql(b.FIVE_BRANDS, "abs(p.score) >= 0.3", [1, 5, 10]) + """
SELECT config, horizon, CAST(count_if(score * ret > 0) AS BIGINT) AS correct, count(*) AS total,
       round(count_if(score * ret > 0) / count(*), 6) AS accuracy,
       round(100.0 * count_if(score * ret > 0) / count(*) - 58.6, 6) + 0.0 AS gap_pp
FROM pairs GROUP BY config, horizon""",
)
def abnormal_direction_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    horizons = fixed.ABNORMAL_DIRECTION_HORIZONS
    signals = metrics.conviction(b.predictions(spark, sf_dir, b.FIVE_BRANDS))
    panel, bench = b.panels(spark, sf_dir, b.FIVE_BRANDS, horizons)
    returns = metrics.signal_returns(signals, panel, horizons, ["config"], bench)
    accuracy = metrics.direction_accuracy(returns, ["config", "horizon"], zero_return="wrong")
    return rounded(metrics.accuracy_gap(accuracy, 58.6), "accuracy", "gap_pp")


@BOOK.add(
    "score_stats",
    "WITH " + b.predictions_sql(b.FIVE_BRANDS) + """,
grid AS (
  SELECT o_orderstatus AS config, abs(coalesce(p.score, 0)) AS s
  FROM orders CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) t(t)
  LEFT JOIN pred p ON p.article_idx = o_orderkey AND p.ticker = 'Brand#' || t.t AND p.score <> -2)
SELECT config, round(avg(s), 6) AS mean_abs, round(median(s), 6) AS median_abs,
       round(100.0 * count_if(s > 0.3) / count(*), 6) AS pct_above_03,
       round(100.0 * count_if(s > 1.0) / count(*), 6) AS pct_above_10, count(*) AS total_scores
FROM grid GROUP BY config""",
)
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS).filter("score <> -2")
    articles = b.table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("config"))
    stats = metrics.score_stats(signals, articles, ["config"], b.brand_names(b.SEVEN_BRANDS))
    return rounded(stats, "mean_abs", "median_abs", "pct_above_03", "pct_above_10")


@BOOK.add(
    "forward_return",
    "WITH " + b.MARKET_SQL + "," + b.returns_sql("market", "ret") + """
SELECT ticker, date, horizon, round(ret, 6) + 0.0 AS ret, CAST(eff AS INTEGER) AS rows_used FROM ret""",
)
def forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = forward_returns(b.market(spark, sf_dir))
    cells = F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret"), F.col(f"rows_{h}").alias("rows_used"))
        for h in fixed.HORIZONS
    ])
    long = panel.select("ticker", "date", F.explode(cells).alias("c")).select("ticker", "date", "c.*")
    return rounded(long.filter("ret IS NOT NULL"), "ret")


@BOOK.add(
    "asof_next_price",
    "WITH " + b.MARKET_SQL + "," + b.predictions_sql([1, 9, 17, 25]) + """
SELECT p.article_idx, p.ticker, p.date, m.date AS start_date, round(m.close + 1e-9, 6) AS close
FROM (SELECT article_idx, ticker, date + INTERVAL 40 DAY AS d2, CAST(date + INTERVAL 40 DAY AS DATE) AS date FROM pred) p
ASOF LEFT JOIN market m ON p.ticker = m.ticker AND p.date <= m.date""",
)
def asof_next_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.predictions(spark, sf_dir, [1, 9, 17, 25])
    events = signals.select("article_idx", "ticker", F.date_add("date", 40).alias("date"))
    panel = materialise(b.market(spark, sf_dir), "panel")
    joined = join_as_of(events, panel, ["close"], how="left")
    # The shift keeps exact halves off the rounding boundary, where engines differ.
    return rounded(joined.withColumn("close", F.col("close") + 1e-9), "close").select("article_idx", "ticker", "date", "start_date", "close")


@BOOK.add(
    "asof_event_time",
    """WITH e AS (SELECT event_id, ts, user_id % 40 AS ticker, event_type, value FROM events),
quotes AS (SELECT CAST(ticker AS VARCHAR) AS ticker, ts, max(value) AS price FROM e WHERE event_type = 'purchase' GROUP BY ALL)
SELECT a.event_id, a.ts, CAST(a.ticker AS VARCHAR) AS ticker, q.ts AS quoted_at, round(q.price, 6) AS price
FROM (SELECT * FROM e WHERE event_type <> 'purchase') a ASOF LEFT JOIN quotes q ON CAST(a.ticker AS VARCHAR) = q.ticker AND a.ts <= q.ts""",
)
def asof_event_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the first quote at or after their moment; purchases stand in for quotes."""
    events = b.table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("user_id") % 40).cast("string").alias("ticker"), "event_type", "value"
    )
    quotes = events.filter("event_type = 'purchase'").groupBy("ticker", "ts").agg(F.max("value").alias("price"))
    asked = events.filter("event_type <> 'purchase'").select("event_id", "ts", "ticker")
    found = scan_as_of(asked, quotes, ["price"], moment="ts").withColumnRenamed("start_ts", "quoted_at")
    return rounded(found, "price")


@BOOK.add(
    "abnormal_return",
    abnormal_sql(b.FIVE_BRANDS, "true", [5]) + """
SELECT article_idx, ticker, round(ret, 6) + 0.0 AS ret FROM pairs""",
)
def abnormal_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = b.predictions(spark, sf_dir, b.FIVE_BRANDS).select("article_idx", "ticker", "date")
    joined = join_abnormal(events, *b.panels(spark, sf_dir, b.FIVE_BRANDS, [5]), [5])
    known = joined.filter("ret_5 IS NOT NULL").select("article_idx", "ticker", F.col("ret_5").alias("ret"))
    return rounded(known, "ret")


@BOOK.add(
    "batch_ic",
    raw_sql(b.FIVE_BRANDS, horizons=[5]) + "," + b.SPEARMAN_SQL.format(keys="config, batch") + """,
whole AS (
  SELECT config, count(*) AS n, corr(rx, ry) AS rho FROM (
    SELECT config, rank() OVER (PARTITION BY config ORDER BY score) + (count(*) OVER (PARTITION BY config, score) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY config ORDER BY ret) + (count(*) OVER (PARTITION BY config, ret) - 1) / 2.0 AS ry
    FROM pairs) GROUP BY config)
SELECT config, batch, CASE WHEN n >= 10 THEN round(rho, 6) + 0.0 END AS ic, n FROM spearman
UNION ALL SELECT config, NULL, CASE WHEN n >= 10 THEN round(rho, 6) + 0.0 END, n FROM whole""",
)
def batch_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch, and over the whole run (batch null): ranks of a run do not add up from batches."""
    returns = raw_returns(spark, sf_dir, b.FIVE_BRANDS, [5], ("config", "batch"))
    ic = metrics.batch_information_coefficients(returns, ["config"])
    return rounded(ic, "ic").select("config", "batch", "ic", "n")


@BOOK.add(
    "improvement_check",
    raw_sql(b.FIVE_BRANDS, horizons=[5]) + "," + b.SPEARMAN_SQL.format(keys="config, batch") + """
SELECT config, count(*) AS batches, round(arg_min(rho, batch), 6) + 0.0 AS first_ic,
       round(arg_max(rho, batch), 6) + 0.0 AS last_ic,
       round(arg_max(rho, batch) - arg_min(rho, batch), 6) + 0.0 AS change,
       arg_max(rho, batch) > arg_min(rho, batch) AS improved
FROM spearman WHERE n >= 10 AND rho IS NOT NULL GROUP BY config HAVING count(*) >= 2""",
)
def improvement_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.FIVE_BRANDS, [5], ("config", "batch"))
    batches = metrics.information_coefficient(returns, ["config", "batch"])
    return rounded(metrics.improvement(batches, ["config"]), "first_ic", "last_ic", "change")


MARGINAL_ROLES = {
    "small_base": "F0", "small_memory": "F1", "large_base": "O0",
    "large_memory": "O1", "tuned_base": "P0", "tuned_memory": "P1",
}


@BOOK.add(
    "marginal_contribution",
    raw_sql(b.SEVEN_BRANDS, horizons=[5], variants="status") + "," + b.SPEARMAN_SQL.format(keys="config") + """,
v AS (SELECT max(CASE WHEN config = 'F0' THEN rho END) AS f0, max(CASE WHEN config = 'F1' THEN rho END) AS f1,
             max(CASE WHEN config = 'O0' THEN rho END) AS o0, max(CASE WHEN config = 'O1' THEN rho END) AS o1,
             max(CASE WHEN config = 'P0' THEN rho END) AS p0, max(CASE WHEN config = 'P1' THEN rho END) AS p1,
             max(rho) - min(rho) AS span, arg_max(config, rho) AS best, arg_min(config, rho) AS worst, count(*) AS c
      FROM spearman)
SELECT c AS configs, round(f1 - f0, 6) + 0.0 AS memory_small, round(o1 - o0, 6) + 0.0 AS memory_large,
       round(p1 - p0, 6) + 0.0 AS memory_tuned, round(o0 - f0, 6) + 0.0 AS size,
       round(p0 - o0, 6) + 0.0 AS fine_tuning, round(span, 6) + 0.0 AS ic_range,
       best AS best_config, worst AS worst_config FROM v""",
)
def marginal_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, [5], variants="status")
    ic = metrics.information_coefficient(returns, ["config"])
    return rounded(
        metrics.marginal_contributions(ic, MARGINAL_ROLES),
        "memory_small", "memory_large", "memory_tuned", "size", "fine_tuning", "ic_range",
    )


@BOOK.add(
    "best_worst_config",
    raw_sql(b.SEVEN_BRANDS, horizons=[1, 5], variants="model") + "," + b.SPEARMAN_SQL.format(keys="config, horizon") + """
SELECT horizon, arg_max(config, rho) AS best_config, round(max(rho), 6) + 0.0 AS best_ic,
       arg_min(config, rho) AS worst_config, round(min(rho), 6) + 0.0 AS worst_ic
FROM spearman GROUP BY horizon""",
)
def best_worst_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, [1, 5], variants="model")
    ic = metrics.information_coefficient(returns, ["config", "horizon"])
    return rounded(metrics.best_and_worst(ic, ["horizon"]), "best_ic", "worst_ic")


@BOOK.add(
    "bullish_bias",
    raw_sql(b.SEVEN_BRANDS, horizons=[5]) + """
SELECT config, ticker, count(*) AS n, round(count_if(score > 0) / count(*), 6) AS bullish_share,
       round(count_if(ret > 0) / count(*), 6) AS rise_share, round(count_if(score < 0) / count(*), 6) AS negative_share
FROM pairs GROUP BY config, ticker""",
)
def bullish_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    returns = raw_returns(spark, sf_dir, b.SEVEN_BRANDS, [5])
    return rounded(metrics.bullish_bias(returns, ["config", "ticker"]), "bullish_share", "rise_share", "negative_share")


@BOOK.add(
    "model_disagreement",
    raw_sql(b.FIVE_BRANDS, "true", [5], "model") + """
SELECT a.ticker, count(*) AS disagreements, CAST(count_if((a.score > 0) = (a.ret > 0)) AS BIGINT) AS left_correct,
       CAST(count_if((c.score > 0) = (a.ret > 0)) AS BIGINT) AS right_correct
FROM pairs a JOIN pairs c ON a.article_idx = c.article_idx AND a.ticker = c.ticker
WHERE a.config = 'model0' AND c.config = 'model1' AND a.score * c.score < 0 GROUP BY a.ticker""",
)
def model_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    signals = b.variant_predictions(spark, sf_dir, b.FIVE_BRANDS)
    return metrics.model_disagreement(signals, b.market_panel(spark, sf_dir, [5]), "model0", "model1", 5)


@BOOK.add(
    "strict_forward_return",
    "WITH " + b.MARKET_SQL + "," + b.returns_sql("market", "ret", [20]) + """
SELECT ticker, date, round(ret, 6) + 0.0 AS ret_20 FROM ret WHERE eff = 20""",
)
def strict_forward_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = forward_returns(b.market(spark, sf_dir), [20], strict_horizon=True)
    return rounded(panel.filter("ret_20 IS NOT NULL"), "ret_20").select("ticker", "date", "ret_20")
