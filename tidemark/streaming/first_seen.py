"""The first arrival of each key in a stream, from an index on disk instead of endless state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts of the index, 64-bit words of a part's filter, and words that a key marks.
BUCKETS = 64
WORDS = 1 << 14
MARKS = 3


def marked(keys: DataFrame) -> DataFrame:
    """``_bucket, _word, _bit``: the bits that the keys (with ``_bucket``, ``_hash``) mark in the filters."""
    places = F.array(*[F.pmod(F.xxhash64("_hash", F.lit(i)), F.lit(64 * WORDS)) for i in range(MARKS)])
    each = keys.select("_bucket", "_hash", F.explode(F.array_distinct(places)).alias("_place"))
    return each.select(
        "_bucket", "_hash", F.floor(F.col("_place") / 64).alias("_word"), F.expr("shiftleft(1L, cast(_place % 64 as int))").alias("_bit")
    )


def first_seen_writer(folder: str, keys: list[str], order: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes, per micro-batch, the rows whose key no earlier batch has brought, the first of each by
    ``order``.

    What was seen is a table of keys in ``BUCKETS`` parts with a Bloom filter each, both appended
    batch by batch; no state is kept between batches. A key is looked up in its part's filter, a
    few words of fixed number. Only keys that all their bits say were seen are compared with the
    keys themselves, so the result is exact however full the filters are. A batch that is run
    again reads the batches before it and replaces what it wrote.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        path = lambda name: f"{folder}/{name}/batch={batch_id}"
        # As one struct, keys with nulls in them are equal too.
        rows = batch.withColumns({"_key": F.struct(*keys), "_hash": F.xxhash64(*keys), "_place": F.struct(*order)})
        rows = rows.withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)).cast("int"))
        least = rows.groupBy("_bucket", "_hash", "_key").agg(F.min("_place").alias("_first"))
        least.write.mode("overwrite").parquet(path("arrived"))
        arrived = spark.read.schema(least.schema).parquet(path("arrived"))
        fresh = arrived
        if batch_id > 0:
            earlier = lambda name: spark.read.parquet(f"{folder}/{name}").filter(F.col("batch") < batch_id)
            filters = earlier("filters").groupBy("_bucket", "_word").agg(F.bit_or("_bits").alias("_bits"))
            asked = marked(arrived).join(filters, ["_bucket", "_word"], "left")
            held = asked.groupBy("_hash").agg(F.bool_and(F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).alias("held"))
            suspects = arrived.join(held.filter("held"), "_hash", "left_semi").select("_bucket", "_hash", "_key")
            known = suspects.join(earlier("keys").select("_bucket", "_hash", "_key"), ["_bucket", "_hash", "_key"], "left_semi")
            fresh = arrived.join(known, ["_bucket", "_hash", "_key"], "left_anti")
        fresh.select("_hash", "_key", "_first", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(path("keys"))
        brought = spark.read.schema(fresh.select("_hash", "_key", "_first", "_bucket").schema).parquet(path("keys"))
        bits = marked(brought).groupBy("_bucket", "_word").agg(F.bit_or("_bit").alias("_bits"))
        bits.write.mode("overwrite").parquet(path("filters"))
        # The rows themselves, by the place of the first; they are looked at only now.
        chosen = brought.select("_hash", "_key", F.col("_first").alias("_place"))
        first = rows.join(chosen, ["_hash", "_key", "_place"], "left_semi").select(*batch.columns)
        first.write.mode("overwrite").parquet(path("rows"))

    return write
