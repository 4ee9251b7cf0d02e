"""Top-k selection and bounded text assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.prefix import running_totals
from tidemark.session import materialise


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, position: str = "pos") -> DataFrame:
    """First ``k`` rows per group, with their position from 1.

    ``row_number() <= k`` lets Spark cut every group to k rows in each task before the shuffle,
    so a hot group sends k rows per task.
    """
    ranked = df.withColumn(position, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(position) <= k)


def joined_text(position: str, text: Column | str, separator: str) -> Column:
    """Aggregate that joins texts in ``position`` order; for groups already cut to a few rows."""
    body = F.col(text) if isinstance(text, str) else text
    rows = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), body.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), separator)


def ordered_text(
    rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str, fan: int = 512, name: str = "texts"
) -> DataFrame:
    """``keys, text``: the texts of each group joined in the order of ``order`` (ascending; with the
    keys it must tell rows apart), for groups of any size.

    Places are counted on narrow rows. Then up to ``fan`` neighbours are joined at a time, level by
    level, so a task holds that many parts of a group and never the rows of all of it.
    """
    written = materialise(rows.select(*keys, *order, F.col(text).alias("_text")), name)
    places = running_totals(written.select(*keys, *order, F.lit(1).cast("long").alias("_one")), keys, order, ["_one"], name)
    level = written.join(places.select(*keys, *order, F.col("_one_before").alias("_pos")), [*keys, *order])
    level = materialise(level.select(*keys, "_pos", "_text"), name)
    last = level.agg(F.coalesce(F.max("_pos"), F.lit(0))).first()[0]
    while True:
        part = F.floor(F.col("_pos") / fan).alias("_part")
        joined = level.groupBy(*keys, part).agg(joined_text("_pos", "_text", separator).alias("_text"))
        level, last = joined.withColumnRenamed("_part", "_pos"), last // fan
        if not last:
            return level.select(*keys, F.col("_text").alias(text))
        level = materialise(level, name)
