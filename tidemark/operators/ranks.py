"""Ranks, rank correlation and order statistics on counted values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running_totals, sliced_totals
from tidemark.session import materialise

#: Pairs of a group that one task may rank.
GROUP_ROWS = 1 << 17


def average_ranks(
    counts: DataFrame, keys: list[str], value: str, count: str = "n", written: bool = False
) -> DataFrame:
    """Average rank of each distinct value, scaled to (-0.5, 0.5) around the group's middle.

    ``counts`` holds one row per (keys, value) with the number of times it occurs. Ties share the
    mean of the positions they take. The scaled form keeps sums exact enough for any group size.
    ``written`` says that the counts are a written table already.
    """
    totals = sliced_totals if written else running_totals
    ranked = totals(counts, keys, [value], [count], name="ranks")
    middle = (F.col(f"{count}_total") + 1) / 2
    rank = F.col(f"{count}_before") + (F.col(count) + 1) / 2
    return ranked.withColumn("rank", (rank - middle) / F.col(f"{count}_total"))


def rank_correlation(pairs: DataFrame, keys: list[str], x: str, y: str, count: str = "n") -> DataFrame:
    """Spearman correlation of ``x`` and ``y`` per group: one row ``keys, ic, n``.

    ``pairs`` holds counted (x, y) pairs; it is read twice, so pass a written or cheap frame.
    Only distinct values are ranked: the ranks of ``x`` are joined once, and ``y`` is ranked in
    its already summed form, so both sides shuffle partial sums per value and a frequent value
    weighs no more than a rare one. ``ic`` is null when either side is constant. Where every group
    is small, its pairs are ranked together instead.
    """
    cells = pairs.select(*keys, x, y, F.col(count).alias("n"))
    if small_groups(cells, keys):
        return grouped_correlation(cells, keys, x, y)
    x_counts = cells.groupBy(*keys, x).agg(F.sum("n").alias("n"))
    # Counted on the way: few distinct scores are broadcast and the pairs stay where they are,
    # many are shuffled, with AQE splitting a frequent value.
    x_ranks = average_ranks(x_counts, keys, x).select(*keys, x, F.col("rank").alias("x_rank"))
    by_y = cells.join(x_ranks, [*keys, x]).groupBy(*keys, y).agg(F.sum("n").alias("n"), *_x_sums("x_rank", "x"))
    return _correlation(average_ranks(by_y, keys, y), keys)


def nested_rank_correlation(
    pairs: DataFrame, keys: list[str], whole: list[str], x: str, y: str, count: str = "n"
) -> tuple[DataFrame, DataFrame]:
    """:func:`rank_correlation` per group of ``keys`` and per group of ``whole``, some of the keys.

    Counts of values add up: those of a whole are the sums of its groups' counts, so a further
    group only adds its own. Each pair meets the rank that its ``x`` has in its group and in the
    whole at once and is summed by ``y`` once; the whole is ranked on these sums. Where every group
    of ``keys`` is small, its pairs are ranked together, and the whole alone is counted by value.
    """
    cells = pairs.select(*keys, x, y, F.col(count).alias("n"))
    if small_groups(cells, keys):
        # Only pairs that a group holds count for the whole.
        held = cells.filter(_known(keys))
        return grouped_correlation(cells, keys, x, y), rank_correlation(held, whole, x, y)
    x_counts = materialise(cells.groupBy(*keys, x).agg(F.sum("n").alias("n")), "x-counts")
    in_group = average_ranks(x_counts, keys, x).select(*keys, x, F.col("rank").alias("x_rank"))
    whole_counts = x_counts.groupBy(*whole, x).agg(F.sum("n").alias("n"))
    in_whole = average_ranks(whole_counts, whole, x).select(*whole, x, F.col("rank").alias("whole_rank"))
    by_y = materialise(
        cells.join(in_group, [*keys, x]).join(in_whole, [*whole, x]).groupBy(*keys, y).agg(
            F.sum("n").alias("n"), *_x_sums("x_rank", "x"), *_x_sums("whole_rank", "whole")
        ),
        "by-y",
    )
    of_whole = by_y.groupBy(*whole, y).agg(
        F.sum("n").alias("n"), F.sum("whole_sum").alias("x_sum"), F.sum("whole_square").alias("x_square")
    )
    grouped = by_y.drop("whole_sum", "whole_square")
    return _correlation(average_ranks(grouped, keys, y, written=True), keys), _correlation(average_ranks(of_whole, whole, y), whole)


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def small_groups(cells: DataFrame, keys: list[str]) -> bool:
    """Whether no group has more than ``GROUP_ROWS`` pairs; groups alone are counted for that."""
    largest = cells.groupBy(*keys).agg(F.count("*").alias("_rows")).agg(F.max("_rows")).first()[0]
    return (largest or 0) <= GROUP_ROWS


def grouped_correlation(cells: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """:func:`rank_correlation` of small groups: one shuffle brings the pairs of a group together,
    where they are ranked by ``x`` and by ``y``."""

    def ranked(rows: DataFrame, value: str, name: str) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(value)
        total = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        upto = F.sum("n").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        ties = F.sum("n").over(order.rangeBetween(Window.currentRow, Window.currentRow))
        sums = rows.withColumns({"_total": total, "_upto": upto, "_ties": ties})
        rank = F.col("_upto") - F.col("_ties") + (F.col("_ties") + 1) / 2
        return sums.withColumn(name, (rank - (F.col("_total") + 1) / 2) / F.col("_total")).drop("_total", "_upto", "_ties")

    both = ranked(ranked(cells.filter(_known([*keys, x])), x, "_x_rank"), y, "rank")
    sums = both.withColumns({"x_sum": F.col("n") * F.col("_x_rank"), "x_square": F.col("n") * F.col("_x_rank") * F.col("_x_rank")})
    return _correlation(sums, keys)


def _x_sums(rank: str, name: str) -> list[Column]:
    weighted = F.col("n") * F.col(rank)
    return [F.sum(weighted).alias(f"{name}_sum"), F.sum(weighted * F.col(rank)).alias(f"{name}_square")]


def _correlation(y_ranks: DataFrame, keys: list[str]) -> DataFrame:
    return (
        y_ranks.groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("x_sum") * F.col("rank")).alias("_xy"),
            F.sum("x_square").alias("_xx"),
            F.sum(F.col("n") * F.col("rank") * F.col("rank")).alias("_yy"),
        )
        .select(
            *keys,
            F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx") * F.col("_yy"))).alias("ic"),
            "n",
        )
    )


def weighted_median(counts: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """Median with the mean of the two middle values, from counted distinct values."""
    ranked = running_totals(counts, keys, [value], [count], name="median")
    lower = F.floor((F.col(f"{count}_total") - 1) / 2)
    upper = F.floor(F.col(f"{count}_total") / 2)
    first, last = F.col(f"{count}_before"), F.col(f"{count}_before") + F.col(count) - 1

    def at(position):
        return F.max(F.when((first <= position) & (position <= last), F.col(value)))

    return ranked.groupBy(*keys).agg(((at(lower) + at(upper)) / 2).alias("median"))
