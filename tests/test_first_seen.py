"""First arrivals by an index on disk: late repeats, nulls, full filters, batches that run again."""

import random
import time

import pytest

from tidemark.streaming import first_seen, runs

SCHEMA = "seq long, a string, b long, text string"


def batches_of(seed, n=6):
    rng, seq, out = random.Random(seed), 0, []
    for _ in range(n):
        rows = []
        for _ in range(80):
            rows.append((seq, rng.choice(["x", "y", "z", None]), rng.choice([*range(30), None]), f"t{seq}"))
            seq += 1
        out.append(rows)
    # A key of the first batch comes again in the last one, and nowhere between.
    out[0].append((1000, "once", 1, "first"))
    out[-1].append((1001, "once", 1, "late"))
    return out


def expected(batches):
    seen, out = set(), []
    for rows in batches:
        for row in sorted(rows):
            if row[1:3] not in seen:
                seen.add(row[1:3])
                out.append(row)
    return out


@pytest.mark.parametrize("words", [1, 1 << 14])
def test_first_of_each_key(spark, tmp_path, monkeypatch, words):
    # One word holds 64 bits: the filters are full at once, and the result is the same.
    monkeypatch.setattr(first_seen, "WORDS", words)
    batches = batches_of(words)
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.01)
    stream = runs.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], SCHEMA).schema, files_per_trigger=1)
    folder = str(tmp_path / "out")
    writer = first_seen.first_seen_writer(folder, ["a", "b"], ["seq"])
    query = runs.run_batches(stream, writer, str(tmp_path / "cp"))
    got = lambda: [tuple(r)[:4] for r in runs.batches(spark, f"{folder}/rows").collect()]
    assert sorted(got(), key=str) == sorted(expected(batches), key=str)
    assert not query.lastProgress.stateOperators
    # The last batch again: it replaces what it wrote.
    writer(spark.createDataFrame(batches[-1], SCHEMA), len(batches) - 1)
    assert sorted(got(), key=str) == sorted(expected(batches), key=str)
