"""Prediction episodes, their outcomes and accuracy by category."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.operators.metrics import conviction
from tidemark.operators.returns import join_as_of
from tidemark.operators.topk import top_k


def actual_direction(ret: Column, zero_policy: str = "bearish") -> Column:
    """``zero_policy`` names an unchanged price: bearish or neutral."""
    return F.when(ret > 0, "bullish").when(ret < 0, "bearish").otherwise(zero_policy)


def record_episodes(
    signals: DataFrame,
    panel: DataFrame,
    horizon: int = fixed.EPISODE_HORIZON,
    zero_policy: str = "bearish",
    min_score: float = fixed.MIN_SCORE,
) -> DataFrame:
    """Signals of conviction with their outcome; rows without a known return are left out.

    Each ticker gets its own return. ``available_on`` is the day the outcome is known, for
    callers that must not look ahead.
    """
    joined = join_as_of(conviction(signals, min_score), panel, [f"ret_{horizon}", f"end_{horizon}"])
    ret = F.col(f"ret_{horizon}")
    return (
        joined.filter(ret.isNotNull())
        .withColumns(
            {
                "predicted_direction": F.when(F.col("score") > 0, "bullish").otherwise("bearish"),
                "actual_direction": actual_direction(ret, zero_policy),
                "actual_return": ret,
                "available_on": F.col(f"end_{horizon}"),
            }
        )
        .withColumn("was_correct", F.col("predicted_direction") == F.col("actual_direction"))
        .withColumnRenamed("score", "predicted_score")
        .drop(f"ret_{horizon}", f"end_{horizon}", "start_date")
    )


def resolved(episodes: DataFrame, ticker: str | None = None, source: str | None = None) -> DataFrame:
    """Episodes with a known outcome, optionally of one ticker or source."""
    out = episodes.filter("was_correct IS NOT NULL")
    if ticker is not None:
        out = out.filter(F.col("ticker") == ticker)
    if source is not None:
        out = out.filter(F.col("source") == source)
    return out


def latest_episodes(episodes: DataFrame, keys: list[str], k: int, tie: list[Column]) -> DataFrame:
    """The ``k`` most recent resolved episodes per group."""
    return top_k(resolved(episodes), keys, [F.desc("date"), *tie], k)


def category_counts(episodes: DataFrame, keys: list[str] = [], together: bool = False) -> DataFrame:
    """``keys, family, key, correct, total`` for ticker, source, direction and overall.

    Episodes are first summed per (ticker, source, direction); only those few sums are repeated
    for the four groupings. Where ``keys`` make small groups that lie ``together`` in a partition,
    such sums are about as many as the episodes, and are left out.
    """
    fields = ["ticker", "source", "predicted_direction"]
    cells = resolved(episodes).select(*keys, *fields, F.col("was_correct").cast("long").alias("correct"), F.lit(1).cast("long").alias("total"))
    if not together:
        cells = cells.groupBy(*keys, *fields).agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    families = F.array(
        F.struct(F.lit("ticker").alias("family"), F.col("ticker").alias("key")),
        F.struct(F.lit("source").alias("family"), F.col("source").alias("key")),
        F.struct(F.lit("direction").alias("family"), F.col("predicted_direction").alias("key")),
        F.struct(F.lit("overall").alias("family"), F.lit("all").alias("key")),
    )
    return (
        cells.select(*keys, F.explode(families).alias("f"), "correct", "total")
        .groupBy(*keys, "f.family", "f.key")
        .agg(F.sum("correct").alias("correct"), F.sum("total").alias("total"))
    )


def accuracy_by_category(episodes: DataFrame, keys: list[str] = []) -> DataFrame:
    return category_counts(episodes, keys).withColumn(
        "accuracy", F.coalesce(F.try_divide("correct", "total"), F.lit(0.0))
    )


def accuracy_counts(history: DataFrame) -> DataFrame:
    """Correct, incorrect and pending signals and the accuracy of the decided ones."""
    correct = F.count_if(F.col("was_correct"))
    incorrect = F.count_if(~F.col("was_correct"))
    return history.agg(
        correct.alias("correct"),
        incorrect.alias("incorrect"),
        F.count_if(F.col("was_correct").isNull()).alias("pending"),
        F.coalesce(F.try_divide(correct, correct + incorrect), F.lit(0.0)).alias("accuracy"),
    )
