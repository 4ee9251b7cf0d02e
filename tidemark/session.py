"""Session settings and shared scratch tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="tidemark-")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver may do without that setting: it
    gets a temporary folder. On a cluster every machine would write to its own disk, so the
    setting is asked for.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        return _local_root()
    raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of this run below the shared folder."""
    return f"{scratch_root(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where a frame feeds several branches or holds a column that must not change when a
    lost task is run again. The written files also give Catalyst the real size of the frame,
    so it broadcasts the frame in later joins only when it is measurably small and otherwise
    shuffles it with AQE's skew handling.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int | None = None) -> DataFrame:
    """Split a freshly read frame over all cores when its files give fewer partitions than that.

    Meant for costly work per row on few or unsplittable files. Large inputs have more partitions
    than cores and pass through unchanged, so nothing is shuffled at scale. Where small rows are
    expanded next, a few MB of file can be very many of them: ``rows`` is what a task should get,
    and then the number of rows decides. Files tell it without being read.
    """
    parts = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        parts = max(parts, -(-df.select().count() // rows))
    return df if df.rdd.getNumPartitions() >= parts else df.repartition(parts, *keys)
