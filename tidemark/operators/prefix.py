"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    measures: list[str],
    name: str = "prefix",
) -> DataFrame:
    """Add ``<m>_before`` (total of the earlier rows) and ``<m>_total`` for every measure.

    ``keys + order`` must be unique, so aggregate first. The rows are written, since a range
    partitioning reads them twice, and no group has to fit a task, whatever its size.
    """
    return sliced_totals(materialise(df, name), keys, order, measures, name)


def sliced_totals(
    rows: DataFrame, keys: list[str], order: list[str], measures: list[str], name: str = "prefix"
) -> DataFrame:
    """The same result from range partitions.

    The rows are range partitioned by ``keys + order``, each slice is summed on its own, and one
    row per (group, slice) is enough to add up the earlier slices. The slices are written out
    first, because slice numbers must stay the same however often a stage is run again.
    """
    sliced = materialise(
        rows.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()),
        f"{name}-sliced",
    )
    slice_sums = sliced.groupBy(*keys, "_slice").agg(*[F.sum(m).alias(m) for m in measures])
    # One row per slice of a group: no more rows than there are shuffle partitions.
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = slice_sums.select(
        *keys,
        "_slice",
        *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"_{m}_offset") for m in measures],
        *[F.sum(m).over(whole).alias(f"{m}_total") for m in measures],
    )
    within = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        sliced.join(offsets, [*keys, "_slice"])
        .withColumns(
            {
                f"{m}_before": F.coalesce(F.sum(m).over(within), F.lit(0)) + F.col(f"_{m}_offset")
                for m in measures
            }
        )
        .drop("_slice", *[f"_{m}_offset" for m in measures])
    )
