"""Groups that a task can hold are ranked without tables between."""

import random

from tidemark.operators import ranks


def test_small_groups_are_ranked_without_tables_between(spark, monkeypatch):
    draw = random.Random(5)
    rows = [("ab"[i % 2], i // 40, float(draw.randint(-4, 4)), draw.choice([-0.0, 0.0, 0.5, 1.5, 2.5]), draw.randint(1, 3)) for i in range(800)]
    rows += [("a", 99, 1.0, float(i), 1) for i in range(5)] + [("a", None, 1.0, 2.0, 1)]
    pairs = spark.createDataFrame(rows, "config string, batch long, score double, ret double, n long").filter("batch IS NOT NULL OR ret > 5")
    near = lambda df: sorted((*[str(v) for v in r[:-2]], r.n, None if r.ic is None else round(r.ic, 9)) for r in df.collect())
    written, write = [], ranks.materialise
    monkeypatch.setattr(ranks, "materialise", lambda df, name: written.append(name) or write(df, name))
    both = lambda: [near(df) for df in ranks.nested_rank_correlation(pairs, ["config", "batch"], ["config"], "score", "ret")]
    small = both()
    assert not written and any(row[-1] is None for row in small[0]) and len(small[0]) > 20
    monkeypatch.setattr(ranks, "GROUP_ROWS", 0)
    assert both() == small and written
