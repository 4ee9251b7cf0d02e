"""As-of lookups of any resolution against brute force, and streams that land in several files."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.operators.ranks import nested_rank_correlation, rank_correlation
from tidemark.operators.returns import scan_as_of
from tidemark.plans import records
from tidemark.plans.bindings import market, panels

START = dt.datetime(2024, 1, 1)


def test_scan_equals_brute_force(spark):
    rng = random.Random(3)
    at = lambda: START + dt.timedelta(microseconds=rng.choice([0, 1, 5, rng.randrange(10**9)]))
    events = [(i, rng.choice(["a", "a", "a", "b", None]), at()) for i in range(600)] + [(1000 + i, "hot", START) for i in range(300)]
    prices = {("a", at()): float(i) for i in range(60)} | {("hot", START + dt.timedelta(days=1)): 7.0, ("c", START): 1.0}
    df = spark.createDataFrame(events, "id long, ticker string, ts timestamp_ntz").repartition(5)
    rows = spark.createDataFrame([(k, t, p) for (k, t), p in prices.items()], "ticker string, ts timestamp_ntz, price double")
    got = {r.id: (r.start_ts, r.price) for r in scan_as_of(df, rows, ["price"]).collect()}
    assert len(got) == len(events)
    for i, key, moment in events:
        later = sorted((t, p) for (k, t), p in prices.items() if k == key and t >= moment)
        assert got[i] == (later[0] if later else (None, None))


def test_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", START)], "id long, ticker string, ts timestamp_ntz")
    rows = spark.createDataFrame([], "ticker string, ts timestamp_ntz, price double")
    assert [tuple(r) for r in scan_as_of(df, rows, ["price"]).collect()] == [(1, "a", START, None, None)]
    assert scan_as_of(df.limit(0), rows, ["price"]).collect() == []


def test_nested_correlation_is_that_of_each_level(spark):
    rng = random.Random(9)
    pairs = [(c, rng.randrange(4), rng.randrange(5) / 2, rng.randrange(30) / 7, rng.randrange(1, 4)) for c in "xy" for _ in range(300)]
    df = spark.createDataFrame(pairs, "config string, batch int, score double, ret double, n long")
    each, whole = nested_rank_correlation(df, ["config", "batch"], ["config"], "score", "ret")
    near = lambda rows: {tuple(r)[:-2]: (round(r.ic, 9), r.n) for r in rows.collect()}
    assert near(each) == near(rank_correlation(df, ["config", "batch"], "score", "ret"))
    assert near(whole) == near(rank_correlation(df, ["config"], "score", "ret"))


def test_panels_from_one_reading(spark):
    sf_dir = "/root/testdata/sf0.001"
    panel, bench = panels(spark, sf_dir, [1, 2], [5])
    assert {r.ticker for r in panel.select("ticker").distinct().collect()} == {"Brand#1", "Brand#2"}
    alone = {(r.ticker, r.date): r.close for r in market(spark, sf_dir, [1, 2]).collect()}
    assert all(abs(alone[r.ticker, r.date] - r.close) < 1e-9 for r in panel.collect()) and bench.count() > 300


def test_slices_land_in_order_in_several_files(spark, monkeypatch):
    monkeypatch.setattr(records, "FILE_ROWS", 20)
    rows = spark.range(500).select("id", (F.col("id") % 97).alias("at"), F.lit("x").alias("text"))
    stream = records.landed(rows, "landed", "at")
    seen = []
    query = stream.writeStream.foreachBatch(lambda df, i: seen.append([r.at for r in df.collect()])).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(x for batch in seen for x in batch) == sorted(i % 97 for i in range(500))
    assert len(seen) > 1
    assert all(max(a) <= min(b) + 97 // records.SLICES + 1 for a, b in zip(seen, seen[1:]) if a and b)
