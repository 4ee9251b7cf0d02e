"""Texts joined level by level equal a plain join, whatever the size of a group."""

import pytest

from tidemark.operators.topk import ordered_text
from tidemark.sources import predictions as pr


@pytest.mark.parametrize("fan", [2, 3, 512])
def test_levels_keep_the_order(spark, fan):
    rows = [(g, (i * 7) % n, f"{g}:{i}") for g, n in (("a", 1), ("b", 2), ("c", 9), ("d", 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, at long, line string").repartition(3)
    got = {r.g: r.line for r in ordered_text(df, ["g"], ["at"], "line", "\n", fan).collect()}
    assert got == {g: "\n".join(t for _, _, t in sorted((r for r in rows if r[0] == g), key=lambda r: r[1])) for g in "abcd"}
    assert [r.line for r in ordered_text(df.filter("g = 'd'"), [], ["at"], "line", "", fan).collect()] == [got["d"].replace("\n", "")]
    assert ordered_text(df.limit(0), ["g"], ["at"], "line", "\n", fan).collect() == []


def test_metrics_that_were_never_written(spark, tmp_path):
    assert pr.read_metrics(spark, str(tmp_path / "nothing")).collect() == []
