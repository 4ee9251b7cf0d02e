"""Information coefficient, direction accuracy and the reports built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.stats import spearman_p_value
from tidemark.operators.ranks import nested_rank_correlation, rank_correlation, weighted_median
from tidemark.operators.returns import join_abnormal, join_as_of, unpivot_horizons
from tidemark.session import materialise


def conviction(signals: DataFrame, min_score: float = fixed.MIN_SCORE) -> DataFrame:
    """Keep scores of at least ``min_score`` in size."""
    return signals.filter(F.abs("score") >= min_score)


def usable_rows(signals: DataFrame) -> DataFrame:
    """Rows with a date and a score; text scores are read as numbers, others are skipped, and an
    empty text is no date."""
    score = F.col("score")
    if dict(signals.dtypes)["score"] == "string":
        score = F.expr("try_cast(score AS DOUBLE)")
    dated = F.col("date").isNotNull()
    if dict(signals.dtypes)["date"] == "string":
        dated = dated & (F.trim("date") != "")
    return signals.withColumn("score", score).filter(dated & F.col("score").isNotNull())


def in_universe(signals: DataFrame, tickers: list[str]) -> DataFrame:
    """Keep the tickers of a (fixed, small) universe; an IN list is pushed to the scan."""
    return signals.filter(F.col("ticker").isin(tickers))


def count_signals(signals: DataFrame, keys: list[str]) -> DataFrame:
    """Identical signals (same keys, ticker, day and score) become one counted row.

    They share one return, so they are combined on the map side before any join. That takes the
    weight out of a hot ticker or configuration.
    """
    return signals.groupBy(*keys, "ticker", "date", "score").agg(F.count("*").alias("n"))


def signal_returns(
    signals: DataFrame,
    panel: DataFrame,
    horizons: list[int],
    keys: list[str],
    benchmark: DataFrame | None = None,
) -> DataFrame:
    """Counted (keys, horizon, ticker, score, ret) rows; abnormal returns when a benchmark is given.

    Written once with a column per horizon; the long form is made on reading.
    """
    counted = count_signals(usable_rows(signals), keys)
    if benchmark is None:
        joined = join_as_of(counted, panel, [f"ret_{h}" for h in horizons])
    else:
        joined = join_abnormal(counted, panel, benchmark, horizons)
    keep = [*keys, "ticker", "score", "n"]
    wide = materialise(joined.select(*keep, *[f"ret_{h}" for h in horizons]), "signal-returns")
    return unpivot_horizons(wide, horizons, keep)


def information_coefficient(
    returns: DataFrame, keys: list[str], min_pairs: int = fixed.MIN_PAIRS_RAW
) -> DataFrame:
    """``keys, ic, n``: Spearman of score and return, null below ``min_pairs`` pairs."""
    by_key = rank_correlation(returns, keys, "score", "ret")
    return by_key.withColumn("ic", F.when(F.col("n") >= min_pairs, F.col("ic")))


def batch_information_coefficients(
    returns: DataFrame, keys: list[str], batch: str = "batch", min_pairs: int = fixed.MIN_PAIRS_RAW
) -> DataFrame:
    """``keys, batch, ic, n`` per batch and over all batches of a key (batch null), from one pass
    over the pairs."""
    each, whole = nested_rank_correlation(returns, [*keys, batch], keys, "score", "ret")
    kind = dict(returns.dtypes)[batch]
    both = each.unionByName(whole.withColumn(batch, F.lit(None).cast(kind)))
    return both.withColumn("ic", F.when(F.col("n") >= min_pairs, F.col("ic")))


def with_significance(ic: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add the two-sided p-value, its stars and the flag for ``alpha`` to aggregated rows."""
    p = F.col("p_value")
    stars = F.lit("")
    for bound, mark in reversed(fixed.SIGNIFICANCE_STARS):
        stars = F.when(p < bound, mark).otherwise(stars)
    return (
        ic.withColumn("p_value", spearman_p_value(F.col("ic"), F.col("n")))
        .withColumn("stars", stars)
        .withColumn("significant", p < alpha)
    )


def direction_accuracy(returns: DataFrame, keys: list[str], zero_return: str = "down") -> DataFrame:
    """``keys, correct, total, accuracy`` of predicted against actual sign.

    ``zero_return='down'`` counts an unchanged price as a fall; ``'wrong'`` never counts it as a hit.
    """
    up = (F.col("score") > 0) & (F.col("ret") > 0)
    if zero_return == "down":
        hit = up | ((F.col("score") <= 0) & (F.col("ret") <= 0))
    else:
        hit = up | ((F.col("score") < 0) & (F.col("ret") < 0))
    return (
        returns.groupBy(*keys)
        .agg(
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("correct"),
            F.sum("n").alias("total"),
        )
        .withColumn("accuracy", F.try_divide("correct", "total"))
    )


def score_stats(signals: DataFrame, articles: DataFrame, keys: list[str], tickers: list[str]) -> DataFrame:
    """Spread of |score| over the whole universe, a missing ticker counting as 0.

    ``articles`` has one row per prediction; unreadable (null) scores count neither as present
    nor as missing. The missing zeros are added as one counted row per
    group rather than by expanding predictions by tickers.
    """
    present = (
        in_universe(signals, tickers)
        .groupBy(*keys, F.abs("score").alias("size"))
        .agg(F.count("*").alias("n"))
    )
    missing = (
        articles.groupBy(*keys)
        .agg((F.count("*") * len(tickers)).alias("n"))
        .select(*keys, F.lit(0.0).alias("size"), "n")
        .unionByName(present.select(*keys, F.lit(0.0).alias("size"), (-F.col("n")).alias("n")))
    )
    counts = materialise(
        present.unionByName(missing)
        .filter("size IS NOT NULL")
        .groupBy(*keys, "size")
        .agg(F.sum("n").alias("n"))
        .filter("n > 0"),
        "score-counts",
    )
    share = lambda bound: 100 * F.sum(F.when(F.col("size") > bound, F.col("n")).otherwise(0)) / F.sum("n")
    spread = counts.groupBy(*keys).agg(
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean_abs"),
        share(0.3).alias("pct_above_03"),
        share(1.0).alias("pct_above_10"),
        F.sum("n").alias("total_scores"),
    )
    return spread.join(weighted_median(counts, keys, "size"), keys).withColumnRenamed("median", "median_abs")


def marginal_contributions(ic: DataFrame, roles: dict[str, str], min_configs: int = 4) -> DataFrame:
    """One row of differences between named configurations.

    ``roles`` maps ``small_base, small_memory, large_base, large_memory, tuned_base,
    tuned_memory`` to configuration names. A missing IC counts as 0; with fewer than
    ``min_configs`` known values there is no row.
    """
    value = {
        role: F.coalesce(F.max(F.when(F.col("config") == name, F.col("ic"))), F.lit(0.0))
        for role, name in roles.items()
    }
    zero = F.lit(0.0)
    get = lambda role: value.get(role, zero)
    return (
        ic.filter("ic IS NOT NULL")
        .agg(
            F.count("*").alias("configs"),
            (get("small_memory") - get("small_base")).alias("memory_small"),
            (get("large_memory") - get("large_base")).alias("memory_large"),
            (get("tuned_memory") - get("tuned_base")).alias("memory_tuned"),
            (get("large_base") - get("small_base")).alias("size"),
            (get("tuned_base") - get("large_base")).alias("fine_tuning"),
            (F.max("ic") - F.min("ic")).alias("ic_range"),
            F.min_by("config", F.struct(-F.col("ic"), "config")).alias("best_config"),
            F.min_by("config", F.struct("ic", "config")).alias("worst_config"),
        )
        .filter(F.col("configs") >= min_configs)
    )


def improvement(batch_ic: DataFrame, keys: list[str]) -> DataFrame:
    """First and last known batch IC per group, their difference and whether it rose."""
    known = batch_ic.filter("ic IS NOT NULL")
    return (
        known.groupBy(*keys)
        .agg(
            F.count("*").alias("batches"),
            F.min_by("ic", "batch").alias("first_ic"),
            F.max_by("ic", "batch").alias("last_ic"),
        )
        .filter("batches >= 2")
        .withColumn("change", F.col("last_ic") - F.col("first_ic"))
        .withColumn("improved", F.col("last_ic") > F.col("first_ic"))
    )


def accuracy_gap(accuracy: DataFrame, baseline_percent: float) -> DataFrame:
    """Difference in percentage points from a fixed comparison accuracy."""
    return accuracy.withColumn("gap_pp", F.col("accuracy") * 100 - baseline_percent)


def bullish_bias(returns: DataFrame, keys: list[str]) -> DataFrame:
    """Share of bullish signals against the share of rises, and the share of negative scores."""
    share = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    return returns.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        share(F.col("score") > 0).alias("bullish_share"),
        share(F.col("ret") > 0).alias("rise_share"),
        share(F.col("score") < 0).alias("negative_share"),
    )


def model_disagreement(signals: DataFrame, panel: DataFrame, left: str, right: str, horizon: int) -> DataFrame:
    """Where two models disagree on the sign of an (article, ticker), and who was right.

    The two scores meet in one aggregation per (article, ticker), not in a self join.
    """
    score_of = lambda name: F.max(F.when(F.col("config") == name, F.col("score")))
    both = (
        signals.filter(F.col("config").isin(left, right))
        .groupBy("article_idx", "ticker", "date")
        .agg(score_of(left).alias("left_score"), score_of(right).alias("right_score"))
        .filter(F.signum("left_score") * F.signum("right_score") < 0)
    )
    counted = both.groupBy("ticker", "date", F.signum("left_score").alias("left_sign")).agg(
        F.count("*").alias("n")
    )
    known = join_as_of(counted, panel, [f"ret_{horizon}"]).filter(F.col(f"ret_{horizon}").isNotNull())
    rises = F.col(f"ret_{horizon}") > 0
    left_right = (F.col("left_sign") > 0) == rises
    return known.groupBy("ticker").agg(
        F.sum("n").alias("disagreements"),
        F.sum(F.when(left_right, F.col("n")).otherwise(0)).alias("left_correct"),
        F.sum(F.when(~left_right, F.col("n")).otherwise(0)).alias("right_correct"),
    )


def best_and_worst(ic: DataFrame, keys: list[str]) -> DataFrame:
    """Configuration with the highest and the lowest IC per group; of equal ones the first by name."""
    return ic.filter("ic IS NOT NULL").groupBy(*keys).agg(
        F.min_by("config", F.struct(-F.col("ic"), "config")).alias("best_config"),
        F.max("ic").alias("best_ic"),
        F.min_by("config", F.struct("ic", "config")).alias("worst_config"),
        F.min("ic").alias("worst_ic"),
    )
