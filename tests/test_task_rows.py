"""Work per task follows rows, not the number of files."""

from pyspark.sql import functions as F

from tidemark.operators.episodes import category_counts
from tidemark.plans import bindings
from tidemark.session import spread


def test_rows_decide_how_far_a_small_file_is_spread(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "rows")
    spark.range(5000).coalesce(1).write.parquet(path)
    assert spread(spark.read.parquet(path), "id", rows=500).rdd.getNumPartitions() == 10
    assert spread(spark.read.parquet(path), "id", rows=5000).rdd.getNumPartitions() == spread(spark.read.parquet(path), "id").rdd.getNumPartitions()
    monkeypatch.setattr(bindings, "TASK_ORDERS", 100)
    sf_dir = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert bindings.predictions(spark, sf_dir, [1, 2]).rdd.getNumPartitions() == -(-orders // 100)


def test_batches_that_lie_together_are_counted_in_one_step(spark):
    rows = [(i % 3, "AB"[i % 2], "xyz"[i % 3], "up" if i % 5 else None, None if i % 7 == 0 else i % 4 == 0) for i in range(300)]
    seen = spark.createDataFrame(rows, "batch long, ticker string, source string, predicted_direction string, was_correct boolean")
    together = category_counts(seen.repartition("batch"), ["batch"], together=True)
    plan = together._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert sorted(map(str, together.collect())) == sorted(map(str, category_counts(seen, ["batch"]).collect()))
