"""Exported metrics are those of the evaluation."""

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"


def test_exported_metrics_are_the_evaluated_ones(spark):
    run = lambda name: entry.queries()[name](spark, SF_DIR).collect()
    exported = run("metrics_export")
    ic = {(r.config, r.horizon): (r.ic, r.n) for r in run("ic_by_config_horizon")}
    hits = {r.config: (r.correct, r.total, r.accuracy) for r in run("direction_accuracy")}
    assert {(r.config, r.horizon): (r.ic, r.n) for r in exported} == ic
    assert {r.config: (r.correct, r.total, r.accuracy) for r in exported} == hits
    assert all(0 <= r.p_value <= 1 for r in exported if r.ic is not None)
    assert any(r.ic is not None and r.correct > 0 for r in exported)
