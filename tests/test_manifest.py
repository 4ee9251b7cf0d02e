"""Tables of a batch become visible together, and a batch that runs again is visible once."""

import pytest

from tidemark.sources.manifest import commit, committed, compact

SCHEMA = "id long, m map<string,string>"


def test_batches_that_run_again_and_that_fail(spark, tmp_path):
    folder = str(tmp_path / "store")
    table = lambda *ids: spark.createDataFrame([(i, {"k": "v"}) for i in ids], SCHEMA)
    commit({"a": table(1, 2), "b": table(10)}, folder, 0)
    commit({"a": table(3), "b": table(11)}, folder, 1)
    commit({"a": table(4, 5), "b": table(12)}, folder, 0)
    read = lambda name: sorted((r.batch, r.id) for r in committed(spark, folder, name, SCHEMA).collect())
    assert read("a") == [(0, 4), (0, 5), (1, 3)] and read("b") == [(0, 12), (1, 11)]

    # The second table cannot be written: nothing of the attempt is seen.
    broken = table(8).selectExpr("assert_true(id < 0) IS NULL AS id", "m")
    with pytest.raises(Exception):
        commit({"a": table(7), "b": broken}, folder, 2)
    assert read("a") == [(0, 4), (0, 5), (1, 3)] and read("b") == [(0, 12), (1, 11)]


def test_compaction_takes_the_place_of_its_batches(spark, tmp_path):
    folder = str(tmp_path / "log")
    table = lambda *ids: spark.createDataFrame([(i, {}) for i in ids], SCHEMA)
    read = lambda: committed(spark, folder, "a", SCHEMA)
    ids = lambda: sorted(r.id for r in read().collect())
    for batch in range(3):
        commit({"a": table(batch, 10 + batch)}, folder, batch)
    before = read()
    compact({"a": read().filter("id <> 10").select("id", "m")}, folder, 2)
    assert ids() == [0, 1, 2, 11, 12]
    # Readers that began before still find their files.
    assert before.count() in (5, 6)
    commit({"a": table(3)}, folder, 3)
    assert ids() == [0, 1, 2, 3, 11, 12]
    compact({"a": read().select("id", "m")}, folder, 3)
    assert ids() == [0, 1, 2, 3, 11, 12] and {r.batch for r in read().collect()} == {3}
    # A covered batch that runs again stays covered.
    commit({"a": table(77)}, folder, 1)
    assert 77 not in ids()
