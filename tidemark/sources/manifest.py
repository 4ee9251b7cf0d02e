"""Several tables written as one batch, which a reader sees whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "attempt string, turn long, batch long, first long"


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The attempts that hold: of each batch the last that came to its end, unless a compaction of
    later batches covers it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    last = rows.groupBy("batch").agg(F.max(F.struct("turn", "attempt", "first")).alias("last")).select("batch", "last.*")
    spans = last.filter("first < batch").select(F.col("first").alias("_from"), F.col("batch").alias("_upto"))
    covered = last.join(spans, (F.col("batch") >= F.col("_from")) & (F.col("batch") < F.col("_upto")), "left_anti")
    return covered.select("batch", "attempt")


def commit(tables: dict[str, DataFrame], folder: str, batch: int, first: int | None = None) -> None:
    """Write the tables of a batch, then one row that makes them visible together.

    Each attempt writes to folders of its own, so one that fails leaves files that nobody reads,
    and a batch that runs again takes the place of what it wrote before. With ``first`` the tables
    take the place of all batches from that one on.
    """
    attempt, spark = uuid.uuid4().hex, next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}/batch={batch}/attempt={attempt}")
    log = f"{folder}/manifest"
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(log)
    before = spark.read.schema(MANIFEST).parquet(log).filter(F.col("batch") == batch).count()
    row = (attempt, before, batch, batch if first is None else first)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(log)


def compact(tables: dict[str, DataFrame], folder: str, batch: int) -> None:
    """Put ``tables``, made from what is committed up to ``batch``, in the place of all these batches.

    A reader sees the batches or their compaction, never both: the new files count from the moment
    that the manifest names them. Files that are covered stay for readers that began before.
    """
    spark = next(iter(tables.values())).sparkSession
    first = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.min("first")).first()[0]
    commit(tables, folder, batch, min(first, batch))


def committed(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """The rows of one table in all batches that hold, with their ``batch``."""
    empty = spark.createDataFrame([], schema)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema.fields)
    rows = spark.read.schema(f"{fields}, batch long, attempt string").parquet(f"{folder}/{name}")
    return rows.join(manifest(spark, folder), ["batch", "attempt"], "left_semi").drop("attempt")
