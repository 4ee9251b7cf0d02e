"""Facts as stream state: equal to a walk through the changes, however they are cut into batches."""

import datetime as dt
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import fact_state, runs

START = dt.datetime(2024, 1, 1)


def day(n):
    return START + dt.timedelta(days=n)


def changes(seed):
    rng = random.Random(seed)
    rows = []
    for key in range(60):
        created = rng.randint(0, 80)
        rows.append((key, day(created), "store", "T", "f", f"text {key}", "s", 1.0, day(created + rng.choice([3, 30, 60, 90]))))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            rows.append((key, day(created + rng.randint(1, 100)), "read", *[None] * 6))
    rows += [(999, day(5), "read", *[None] * 6)]
    return sorted((r for r in rows if r[1] <= day(110)), key=lambda r: (r[1], r[2] != "store", r[0]))


def walked(rows, as_of):
    """Live facts at ``as_of`` with their reads, one change after the other."""
    facts = {}

    def gone(fact, at):
        return fact["expires"] < at or fact["reads"] == 0 and fact["created"] + dt.timedelta(days=30) < at

    for key, at, kind, *_, expires in rows:
        if key in facts and gone(facts[key], at):
            del facts[key]
        if kind == "store":
            facts.setdefault(key, {"created": at, "expires": expires, "reads": 0, "last": None})
        elif key in facts:
            facts[key]["reads"] += 1
            facts[key]["last"] = at
    return {k: (f["reads"], f["last"]) for k, f in facts.items() if not gone(f, as_of)}


def streamed(spark, tmp_path, rows, files):
    folder, size = tmp_path / f"in{files}", -(-len(rows) // files)
    for at in range(0, len(rows), size):
        spark.createDataFrame(rows[at : at + size], fact_state.CHANGES).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.01)
    stream = runs.file_stream(spark, str(folder), spark.createDataFrame([], fact_state.CHANGES).schema, files_per_trigger=1)
    out = str(tmp_path / f"out{files}")
    query = runs.run_batches(
        fact_state.fact_versions(stream), runs.batch_writer(out), str(tmp_path / f"cp{files}"), "update", fact_state.STATE_STORE
    )
    return runs.batches(spark, out), query


@pytest.mark.parametrize("files", [1, 5])
def test_stream_equals_a_walk_with_access_counts(spark, tmp_path, files):
    rows = changes(files)
    versions, query = streamed(spark, tmp_path, rows, files)
    standing = fact_state.standing_facts(versions, F.lit(day(110)).cast("timestamp"))
    got = {r.id: (r.access_count, r.last_accessed) for r in standing.collect()}
    assert got == walked(rows, day(110)) and got
    fates = {(r.id, r.fate) for r in versions.select("id", "fate").collect()}
    assert {fate for _, fate in fates} == {"kept", "expired", "pruned"}


def test_state_shrinks_when_facts_go(spark, tmp_path):
    rows = changes(7)
    held = [r for r in rows if r[1] <= day(80)]
    late = [(5000, day(400), "store", "T", "f", "late", "s", 1.0, day(500)), (5001, day(401), "store", "T", "f", "late", "s", 1.0, day(500))]
    _, query = streamed(spark, tmp_path, held + late[:1] + late[1:], 5)
    totals = [json.loads(p.json)["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p.stateOperators]
    assert max(totals) > 10 and totals[-1] <= 2
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != fact_state.STATE_STORE
