"""Files that a stream arrives in hold few bytes, and a slice of them is a batch."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import records


def batches_of(stream):
    seen = []
    stream.writeStream.foreachBatch(lambda df, i: seen.append(sorted(r[0] for r in df.select("at").collect()))).trigger(availableNow=True).start().awaitTermination()
    return seen


@pytest.mark.parametrize("distinct", [400, 2, 1])
def test_landed_files_hold_few_bytes_and_a_batch_is_a_slice(spark, monkeypatch, distinct):
    monkeypatch.setattr(records, "FILE_BYTES", 20_000, raising=False)
    rows = spark.range(400).select("id", (F.col("id") % distinct).alias("at"), F.repeat(F.lit("x"), F.lit(1000)).alias("text"))
    stream = records.landed(rows, "landed", "at")
    folder = stream._jdf.queryExecution().analyzed().collectLeaves().head().toString().split("FileSource[")[1].rstrip("] \n")
    sizes = spark.read.parquet(folder.split("]")[0]).groupBy(F.input_file_name()).agg(F.sum(F.length("text")).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 2 * 20_000
    seen = batches_of(stream)
    assert len(seen) == records.SLICES and sorted(x for batch in seen for x in batch) == sorted(i % distinct for i in range(400))
    filled = [batch for batch in seen if batch]
    assert all(a[-1] < b[0] for a, b in zip(filled, filled[1:]))


def test_fact_changes_land_slice_by_slice(spark, monkeypatch):
    """Changes come by their time, so that none is late for its batch, however many files there are."""
    monkeypatch.setattr(records, "FILE_BYTES", 50_000, raising=False)
    stream = records.landed(records.fact_changes(spark, "/root/testdata/sf0.001"), "fact-changes", "at")
    seen = [batch for batch in batches_of(stream) if batch]
    assert 1 < len(seen) <= records.SLICES and all(a[-1] < b[0] for a, b in zip(seen, seen[1:]))
