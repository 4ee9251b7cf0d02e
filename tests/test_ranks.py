"""Rank correlation, p-values, medians and running totals."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.stats import t_test_p_value
from tidemark.operators import metrics, prefix
from tidemark.operators.prefix import running_totals, sliced_totals
from tidemark.operators.ranks import rank_correlation, weighted_median


def pairs(rng, n, groups=("g", "h")):
    return [
        (rng.choice(groups), round(rng.uniform(-2, 2), 1), rng.choice([0.0, rng.gauss(0, 1)]), rng.randint(1, 3))
        for _ in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, x double, y double, n long")


def expected(rows):
    data = pd.DataFrame([(g, x, y) for g, x, y, n in rows for _ in range(n)], columns=["g", "x", "y"])
    return {
        g: (d["x"].rank().corr(d["y"].rank()), len(d)) for g, d in data.groupby("g")
    }


def test_rank_correlation_matches_pandas(spark):
    rows = pairs(random.Random(3), 400)
    got = {r.g: (r.ic, r.n) for r in rank_correlation(frame(spark, rows), ["g"], "x", "y").collect()}
    for g, (ic, n) in expected(rows).items():
        assert got[g][1] == n
        assert got[g][0] == pytest.approx(ic, abs=1e-12)


def test_constant_side_gives_null(spark):
    rows = [("g", 1.0, float(i), 1) for i in range(12)]
    assert rank_correlation(frame(spark, rows), ["g"], "x", "y").collect()[0].ic is None


def test_scaling_scores_keeps_ic_and_sign_flip_turns_it(spark):
    rows = pairs(random.Random(5), 200, ("g",))
    run = lambda rs: rank_correlation(frame(spark, rs), ["g"], "x", "y").collect()[0].ic
    base = run(rows)
    assert run([(g, 2 * x, y, n) for g, x, y, n in rows]) == pytest.approx(base)
    assert run([(g, -x, y, n) for g, x, y, n in rows]) == pytest.approx(-base)


def test_planted_signal_is_found(spark):
    rows = [("g", float(i), float(i) ** 3, 1) for i in range(-20, 21)]
    assert rank_correlation(frame(spark, rows), ["g"], "x", "y").collect()[0].ic == pytest.approx(1.0)


def test_running_totals_both_ways(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else "cold", i, rng.randint(0, 5)) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, o long, m long").repartition(4)
    plain = running_totals(df, ["k"], ["o"], ["m"])
    cut = sliced_totals(df, ["k"], ["o"], ["m"])
    key = lambda r: (r.k, r.o)
    a = [(r.k, r.o, r.m_before, r.m_total) for r in sorted(plain.collect(), key=key)]
    b = [(r.k, r.o, r.m_before, r.m_total) for r in sorted(cut.collect(), key=key)]
    assert a == b
    seen = {}
    for k, o, m in sorted(rows, key=lambda r: (r[0], r[1])):
        assert next(x for x in a if x[0] == k and x[1] == o)[2] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + m


def test_every_size_takes_the_sliced_way(spark, monkeypatch):
    monkeypatch.setattr(prefix, "sliced_totals", lambda *a: "sliced")
    for n in (0, 1, 20):
        df = spark.range(n).select(F.lit(1).alias("k"), "id", F.lit(1).alias("m"))
        assert running_totals(df, ["k"], ["id"], ["m"]) == "sliced"


@pytest.mark.parametrize("values,median", [([1.0], 1.0), ([1.0, 2.0], 1.5), ([0.0, 0.0, 0.0, 9.0], 0.0), ([3.0, 1.0, 2.0], 2.0)])
def test_weighted_median(spark, values, median):
    rows = spark.createDataFrame([("g", v) for v in values], "g string, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    assert weighted_median(rows, ["g"], "v").collect()[0]["median"] == median


def test_p_value_golden_and_limits():
    assert t_test_p_value(0.5, 10) == pytest.approx(0.14111, abs=5e-6)
    assert t_test_p_value(0.0, 50) == pytest.approx(1.0)
    assert t_test_p_value(1.0, 10) == 0.0
    assert t_test_p_value(None, 10) is None
    # t table: df = 10, t = 2.228 is the 5% point; df = 30, t = 2.750 the 1% point
    for df, t, p in ((10, 2.228139, 0.05), (30, 2.749996, 0.01)):
        r = (t * t / (t * t + df)) ** 0.5
        assert t_test_p_value(r, df + 2) == pytest.approx(p, abs=1e-6)


def test_significance_columns(spark):
    ic = spark.createDataFrame([("a", 0.5, 10), ("b", 0.9, 20), ("c", None, 3)], "config string, ic double, n long")
    rows = {r.config: r for r in metrics.with_significance(ic).collect()}
    assert rows["a"].stars == "" and rows["b"].stars == "***" and rows["b"].significant
    assert rows["c"].p_value is None


def test_marginals_need_four_configs_and_missing_counts_as_zero(spark):
    roles = {"small_base": "a", "small_memory": "b", "large_base": "c", "large_memory": "d", "tuned_base": "e", "tuned_memory": "f"}
    ic = spark.createDataFrame([("a", 0.1), ("b", 0.3), ("c", 0.2), ("e", 0.05)], "config string, ic double")
    row = metrics.marginal_contributions(ic, roles).collect()[0]
    assert row.memory_small == pytest.approx(0.2)
    assert row.memory_large == pytest.approx(-0.2)
    assert (row.best_config, row.worst_config) == ("b", "e")
    assert metrics.marginal_contributions(ic.limit(3), roles).count() == 0
