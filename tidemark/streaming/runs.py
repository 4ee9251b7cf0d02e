"""Structured Streaming forms of the ingestion, counting, ledger, forgetting and outcome work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators import facts as fa
from tidemark.operators.returns import calendar, join_calendar, panel_start
from tidemark.session import materialise, scratch_path
from tidemark.sources import ledger


def file_stream(
    spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_trigger: int | None = None
) -> DataFrame:
    """A stream over the parquet files of a folder that match ``pattern``."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival of each key, however late it comes again: keys are kept for good, so the
    state grows with the number of keys."""
    return stream.dropDuplicates(keys)


def daily_counts(stream: DataFrame, time: str, kind: str, value: str, delay: str = "1 hour") -> DataFrame:
    """Closed days per kind: number of events and mean value."""
    return (
        stream.withWatermark(time, delay)
        .groupBy(F.window(time, "1 day"), kind)
        .agg(F.count("*").alias("events"), F.avg(value).alias("mean_value"))
        .select(F.col("window.start").cast("date").alias("day"), kind, "events", "mean_value")
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process what is available into a parquet table; a later run with the same checkpoint
    continues where this one stopped."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    state_store: str | None = None,
) -> StreamingQuery:
    """Process what is available, batch by batch. A ``state_store`` is set for this query alone."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    if state_store:
        conf.set(name, state_store)
    try:
        query = (
            stream.writeStream.foreachBatch(handle)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    finally:
        conf.set(name, before)
    return query


def batch_writer(folder: str) -> Callable[[DataFrame, int], None]:
    """Writes each micro-batch to its own folder, so a batch that is run again replaces it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def stream_to_scratch(stream: DataFrame, name: str) -> DataFrame:
    spark = stream.sparkSession
    return run_to_table(stream, scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint"))


def ledger_writer(folder: str, id_columns: list[str]) -> Callable[[DataFrame, int], None]:
    """Writes valid trades and rejects of a micro-batch. Each batch owns its folder, so a batch
    that is run again replaces what it wrote."""

    def write(batch: DataFrame, batch_id: int) -> None:
        checked = ledger.with_trade_fields(batch).persist()
        ledger.accepted(checked, id_columns).write.mode("overwrite").parquet(f"{folder}/valid/batch={batch_id}")
        ledger.rejected(checked).write.mode("overwrite").parquet(f"{folder}/rejected/batch={batch_id}")
        checked.unpersist()

    return write


def fact_keeper(folder: str, schema) -> Callable[[DataFrame, int], None]:
    """Adds the facts of each micro-batch to the fact table and touches nothing older: a batch
    costs what it holds. Forgetting is done on reading, by :func:`current_facts`."""

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select(*[f.name for f in schema.fields]).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return keep


def current_facts(spark: SparkSession, folder: str, schema, as_of: Column) -> DataFrame:
    """The facts of all batches that are not forgotten at ``as_of``."""
    stored = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return fa.survivors(stored, as_of)


def outcome_writer(
    folder: str, panel: DataFrame, horizon: int, known_until: Callable[[int], Column]
) -> Callable[[DataFrame, int], None]:
    """Splits signals into outcomes known by the day ``known_until(batch)`` and open ones.

    The signals that the batch before left open are looked at again with those that arrive, so an
    outcome shows up in the first batch that can know it. Only open signals are carried on, and a
    batch that is run again reads and writes the same folders. The calendar of the panel is
    written once, before the first batch.
    """
    columns = [f"ret_{horizon}", f"end_{horizon}"]
    start = panel_start(panel)
    days = materialise(calendar(panel, start).select("ticker", "as_of_day", "start_date", *columns), "calendar")

    def write(batch: DataFrame, batch_id: int) -> None:
        signals = batch
        if batch_id > 0:
            waiting = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/open/batch={batch_id - 1}")
            signals = batch.unionByName(waiting)
        joined = join_calendar(signals, days, start, how="left").persist()
        known = F.coalesce(F.col(f"end_{horizon}") <= known_until(batch_id), F.lit(False))
        joined.filter(known).write.mode("overwrite").parquet(f"{folder}/known/batch={batch_id}")
        joined.filter(~known).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/open/batch={batch_id}")
        joined.unpersist()

    return write


def open_signals(spark: SparkSession, folder: str, schema, last_batch: int) -> DataFrame:
    """The signals that are still open after a batch."""
    return spark.read.schema(schema).parquet(f"{folder}/open/batch={last_batch}")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """All batch folders of one output, with their ``batch`` number."""
    return spark.read.option("basePath", folder).parquet(f"{folder}/batch=*")
