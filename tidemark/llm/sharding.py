"""Two-pass external shuffle into shards."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.shared import written
from tidemark.operators.prefix import running_totals

BUCKET_ROWS = 16_384
BUCKET_BYTES = 32 << 20


def scatter(
    records: DataFrame,
    seed: int,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    size: str | None = None,
) -> DataFrame:
    """First pass: every record, whole, in a random bucket that fits in memory.

    Returns a written table (``bucket``, ``ticket``, ``record``). A record's bucket is a seeded
    hash of its ticket, a number of its own that it gets as it is written, not of anything in
    the record: equal rows, equal keys and equal texts spread like all others. There are as many
    buckets as it takes for a mean of at most ``bucket_rows`` rows and, if ``size`` names a
    column of bytes, ``bucket_bytes`` each.
    """
    bytes_held = F.sum(F.col(f"`{size}`")) if size else F.lit(0)
    rows, held = records.agg(F.count(F.lit(1)), F.coalesce(bytes_held, F.lit(0))).first()
    buckets = max(1, math.ceil(rows / bucket_rows), math.ceil(held / bucket_bytes))
    packed = records.select(F.struct("*").alias("record")).withColumn(
        "ticket", F.monotonically_increasing_id()
    )
    tickets = written(packed, "scatter")
    return tickets.withColumn(
        "bucket", F.pmod(F.xxhash64(F.lit(seed), "ticket"), F.lit(buckets)).cast("int")
    )


def shuffled(scattered: DataFrame, seed: int) -> DataFrame:
    """Second pass: a Fisher-Yates shuffle of each bucket, and each record's ``place``.

    Buckets follow one another by number, so ``place`` counts without gaps from 0 over all
    records. A bucket is put in ticket order before it is shuffled, so a task that is run again
    shuffles alike. Buckets go to tasks by ranges of their numbers, so partitions come in the
    order of their places. The table of first places has a row per bucket; Spark broadcasts it
    while it is small, and whole records then move once.
    """
    sizes = scattered.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    starts = written(
        running_totals(sizes, [], ["bucket"], ["rows"], "buckets").select("bucket", F.col("rows_before").alias("start")), "starts"
    )
    earlier = lambda a, b: F.signum(a["ticket"] - b["ticket"]).cast("int")
    decks = (
        scattered.join(starts, "bucket")
        .repartitionByRange("bucket")
        .groupBy("bucket", "start")
        .agg(F.array_sort(F.collect_list(F.struct("ticket", "record")), earlier).alias("deck"))
        .sortWithinPartitions("bucket")
    )
    return decks.select(
        "start", F.posexplode(F.shuffle("deck", seed)).alias("position", "card")
    ).select((F.col("start") + F.col("position")).alias("place"), F.col("card.record").alias("record"))


def shard_rows(
    records: DataFrame,
    shards: int,
    seed: int = 17,
    bucket_rows: int = BUCKET_ROWS,
    bucket_bytes: int = BUCKET_BYTES,
    size: str | None = None,
) -> DataFrame:
    """``record`` (a struct with all columns of the input), ``shard`` and ``slot``.

    Shards are equal ranges of the shuffled order: their row counts differ by one at most, slots
    are gapless from 0, and a task writes to few shards. Null values, repeated rows, columns of any
    type and clashing names do not matter, since a record is never looked into; an empty table
    gives no rows.
    """
    scattered = scatter(records, seed, bucket_rows, bucket_bytes, size)
    rows = max(1, scattered.count())
    dealt = shuffled(scattered, seed).withColumn("shard", F.expr(f"place * {shards}L div {rows}L"))
    return dealt.select(
        "record",
        F.col("shard").cast("int").alias("shard"),
        F.expr(f"place - (shard * {rows}L + {shards - 1}L) div {shards}L").alias("slot"),
    )


def write_shards(dealt: DataFrame, path: str, files: int | None = None) -> None:
    """Write the records of :func:`shard_rows` as one folder per shard, in slot order.

    Partitions of ``dealt`` are in the order of places already; only a wanted number of ``files``
    moves the records again. Written as zstd, which takes less disk than the default.
    """
    ranged = dealt.repartitionByRange(files, "shard", "slot") if files else dealt
    ordered = ranged.sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What :func:`write_shards` wrote, with the ``schema`` of the dealt records."""
    return spark.read.schema(schema).parquet(path)
