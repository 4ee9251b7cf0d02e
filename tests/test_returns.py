"""As-of joins and forward returns against a plain Python model."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import metrics
from tidemark.operators.returns import forward_returns, join_abnormal, join_as_of, panel_start
from tidemark.session import materialise

DAY0 = dt.date(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def model_return(series, date, horizon):
    """(start, return) of the first row on or after ``date``; None where there is none."""
    start = next((i for i, (d, _) in enumerate(series) if d >= date), None)
    if start is None:
        return None, None
    end = min(start + horizon, len(series) - 1)
    base = series[start][1]
    if end <= start or base == 0:
        return series[start][0], None
    return series[start][0], (series[end][1] - base) / base


@pytest.fixture(scope="module")
def prices():
    rng = random.Random(7)
    out = {}
    for ticker, first in (("A", 0), ("B", 11), ("C", 3)):
        days = sorted(rng.sample(range(first, 60), 25))
        out[ticker] = [(day(d), rng.choice([0.0, 1.0, 2.0, 2.5, 4.0, 5.0])) for d in days]
    return out


def frame(spark, prices):
    rows = [(t, d, c) for t, series in prices.items() for d, c in series]
    return spark.createDataFrame(rows, "ticker string, date date, close double")


def test_as_of_and_horizons_match_model(spark, prices):
    horizons = [1, 5, 20]
    panel = materialise(forward_returns(frame(spark, prices), horizons), "t")
    events = [(t, day(n)) for t in ("A", "B", "C", "D") for n in range(-5, 70)]
    rows = join_as_of(
        spark.createDataFrame(events, "ticker string, date date"), panel, [f"ret_{h}" for h in horizons], "left"
    ).collect()
    assert len(rows) == len(events)
    for row in rows:
        series = prices.get(row.ticker, [])
        for h in horizons:
            start, expected = model_return(series, row.date, h)
            assert row.start_date == start
            got = row[f"ret_{h}"]
            assert got == pytest.approx(expected) if expected is not None else got is None


def test_abnormal_uses_each_sides_own_start(spark, prices):
    bench = [(day(n), 10.0 + (n * 7) % 5) for n in range(4, 58, 3)]
    panel = materialise(forward_returns(frame(spark, prices), [5]), "t")
    bench_panel = materialise(forward_returns(frame(spark, {"ALL": bench}), [5]), "t")
    events = [(t, day(n)) for t in prices for n in range(-3, 65)]
    rows = join_abnormal(
        spark.createDataFrame(events, "ticker string, date date"), panel, bench_panel, [5], "left"
    ).collect()
    for row in rows:
        mine, other = model_return(prices[row.ticker], row.date, 5)[1], model_return(bench, row.date, 5)[1]
        if mine is None or other is None:
            assert row.ret_5 is None
        else:
            assert row.ret_5 == pytest.approx(mine - other)


def test_horizon_clamp_and_last_row(spark):
    series = {"A": [(day(i), float(i + 1)) for i in range(4)]}
    rows = {r.date: r for r in forward_returns(frame(spark, series), [5]).collect()}
    assert rows[day(1)].ret_5 == pytest.approx((4 - 2) / 2)
    assert rows[day(1)].rows_5 == 2 and rows[day(1)].end_5 == day(3)
    assert rows[day(3)].ret_5 is None
    strict = forward_returns(frame(spark, series), [2], strict_horizon=True).collect()
    assert [r.ret_2 is None for r in sorted(strict, key=lambda r: r.date)] == [False, False, True, True]


def test_rows_after_the_event_window_change_nothing_before(spark, prices):
    longer = {t: s + [(day(500), 9.0)] for t, s in prices.items()}
    base = forward_returns(frame(spark, prices), [1]).filter("rows_1 = 1").select("ticker", "date", "ret_1")
    more = forward_returns(frame(spark, longer), [1]).select("ticker", "date", "ret_1")
    assert base.exceptAll(more).count() == 0


def test_hot_ticker_keeps_every_row(spark, prices):
    """A third of all events on one ticker and day."""
    hot = spark.range(3000).select(F.lit("A").alias("ticker"), F.lit(day(20)).alias("date"))
    rest = spark.range(6000).select(
        F.element_at(F.array(F.lit("B"), F.lit("C")), (F.col("id") % 2 + 1).cast("int")).alias("ticker"),
        F.date_add(F.lit(day(12)), (F.col("id") % 30).cast("int")).alias("date"),
    )
    events = hot.unionByName(rest)
    panel = materialise(forward_returns(frame(spark, prices), [1]), "t")
    assert join_as_of(events, panel, ["ret_1"], "left").count() == 9000
    counted = metrics.count_signals(events.withColumn("score", F.lit(1.0)), [])
    assert counted.filter("ticker = 'A'").collect()[0].n == 3000


def test_panel_start(spark, prices):
    assert panel_start(frame(spark, prices)) == min(s[0][0] for s in prices.values())
    assert panel_start(frame(spark, prices).limit(0)) is not None


def test_large_calendar_is_shuffled_with_equal_result(spark, prices):
    panel = materialise(forward_returns(frame(spark, prices), [1]), "t")
    events = spark.createDataFrame([(t, day(n)) for t in "ABCD" for n in range(70)], "ticker string, date date")
    small = join_as_of(events, panel, ["ret_1"], "left")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(small)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        large = join_as_of(events, panel, ["ret_1"], "left")
        assert "SortMergeJoin" in plan(large)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert small.exceptAll(large).count() == 0 and small.count() == large.count()
