"""Ledger, price files and the streaming forms."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.returns import forward_returns
from tidemark.session import materialise
from tidemark.sources import ledger
from tidemark.sources import market as mk
from tidemark.streaming import runs

TRADE = "seq long, created_at string, strategy string, symbol string, side string, quantity double, price double, source string"
ID = ["kind", "created_at", "strategy", "symbol", "side", "quantity", "price", "notional", "source"]


def trade(seq, side="buy", quantity=25.0, price=42.5):
    return (seq, f"2024-01-0{seq}", "s", "ionq", side, quantity, price, "manual")


def test_trade_golden_and_rejects(spark):
    rows = [trade(1, "BUY"), trade(2, "hold"), trade(3, quantity=0.0), trade(4, price=-1.0), trade(5, price=0.0)]
    checked = ledger.with_trade_fields(spark.createDataFrame(rows, TRADE))
    good = {r.seq: r for r in ledger.accepted(checked, ID).collect()}
    assert set(good) == {1, 5}
    assert (good[1].notional, good[1].symbol, good[1].side) == (1062.5, "IONQ", "buy")
    assert len(good[1].record_id) == 16
    assert {r.seq: r.reject_reason for r in ledger.rejected(checked).collect()} == {
        2: "side must be one of: buy, sell, short, cover", 3: "quantity must be positive", 4: "price must be non-negative",
    }


def test_newest_first(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "seq long, created_at string")
    assert [r.seq for r in ledger.newest_first(df).collect()] == [3, 2, 1]
    assert [r.seq for r in ledger.newest_first(df, 1).collect()] == [3]


@pytest.mark.parametrize("text,ok", [('{"a": 1}', True), ("{}", True), ("[1]", False), ("1", False), ("{x", False), (None, False)])
def test_json_object(spark, text, ok):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(ledger.is_json_object(F.col("t")).alias("v")).collect()[0].v is ok


def test_price_files(spark, tmp_path):
    days = pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-03"])
    pd.DataFrame({"Date": days, "Close": [1.0, 2.0, None]}).to_parquet(tmp_path / "AAA.parquet")
    pd.DataFrame({"Date": days, "Close": [9.0, 9.0, 9.0], "Adj Close": [3.0, None, 5.0]}).to_parquet(tmp_path / "BBB.parquet")
    wide = pd.DataFrame({"('Close', 'CCC')": [9.0, 9.0, 9.0], "('Adj Close', 'CCC')": [7.0, 8.0, None], "Date": days})
    wide.to_parquet(tmp_path / "CCC.parquet")
    rows = {(r.ticker, r.date.day): r.close for r in mk.read_market(spark, str(tmp_path)).collect()}
    assert rows == {("AAA", 1): 1.0, ("AAA", 2): 2.0, ("BBB", 1): 3.0, ("BBB", 3): 5.0, ("CCC", 1): 7.0, ("CCC", 2): 8.0}


def test_price_range_bounds(spark):
    df = spark.createDataFrame([("A", dt.date(2024, 1, d), float(d)) for d in range(1, 6)], "ticker string, date date, close double")
    assert mk.price_range(df, "A", end="2024-01-02").count() == 2
    assert mk.price_range(df, "A", "2024-01-03", "2024-01-04").count() == 2
    assert mk.price_range(df, "A", "2025-01-01").count() == 0


def landed(df, tmp_path, name, parts):
    """Files that arrive one after the other."""
    folder = tmp_path / name
    for i in range(parts):
        df.filter(F.col("part") == i).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def test_stream_counts_over_several_batches_equal_batch(spark, tmp_path):
    rows = spark.range(2000).select(
        (F.col("id") % 10).alias("part"),
        F.timestamp_seconds(1704067200 + (F.col("id") % 10) * 43200 + F.col("id")).alias("ts"),
        F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), (F.col("id") % 7).cast("double").alias("value"),
    )
    folder = landed(rows, tmp_path, "events", 10)
    stream = runs.file_stream(spark, folder, rows.schema, files_per_trigger=1)
    counts = runs.daily_counts(stream, "ts", "kind", "value")
    got = runs.run_to_table(counts, str(tmp_path / "out"), str(tmp_path / "cp"))
    last = rows.agg(F.max("ts") - F.expr("INTERVAL 1 HOUR")).collect()[0][0]
    batch = (
        rows.groupBy(F.to_date("ts").alias("day"), "kind").agg(F.count("*").alias("events"), F.avg("value").alias("mean_value"))
        .filter(F.timestamp_add("DAY", F.lit(1), F.col("day").cast("timestamp")) <= F.lit(last))
    )
    assert got.count() == batch.count() > 0
    assert got.exceptAll(batch.select(*got.columns)).count() == 0


def test_stream_dedup_restarts_where_it_stopped(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 2).alias("part"), F.timestamp_seconds(1704067200 + F.col("id")).alias("ts"), (F.col("id") % 10).alias("key"))
    folder = tmp_path / "in"
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for i in range(2):
        rows.filter(F.col("part") == i).coalesce(1).write.mode("append").parquet(str(folder))
        stream = runs.file_stream(spark, str(folder), rows.schema)
        got = runs.run_to_table(runs.deduplicated(stream, ["key"]), out, cp)
        assert sorted(r.key for r in got.collect()) == sorted(set(range(i + 1)) | {k for k in range(10) if k % 2 <= i})


def test_stream_dedup_keeps_each_key_once_however_late(spark, tmp_path):
    rows = spark.range(600).select(
        F.floor(F.col("id") / 100).alias("part"), F.timestamp_seconds(1704067200 + F.floor(F.col("id") / 100) * 864000).alias("ts"), (F.col("id") % 100).alias("key")
    )
    stream = runs.file_stream(spark, landed(rows, tmp_path, "in", 6), rows.schema, files_per_trigger=1)
    got = runs.run_to_table(runs.deduplicated(stream, ["key"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r.key for r in got.collect()) == list(range(100))


def test_stream_ledger_batch_replay_replaces_its_output(spark, tmp_path):
    write = runs.ledger_writer(str(tmp_path), ID)
    batch = spark.createDataFrame([trade(1), trade(2, "hold")], TRADE)
    for _ in range(2):
        write(batch, 0)
    write(spark.createDataFrame([trade(3)], TRADE), 1)
    assert sorted(r.seq for r in runs.batches(spark, f"{tmp_path}/valid").collect()) == [1, 3]
    assert runs.batches(spark, f"{tmp_path}/rejected").count() == 1


def test_stream_facts_append_and_forget_on_reading(spark, tmp_path):
    from tests.test_memory import FACT, fact

    df = spark.createDataFrame(
        [fact(1, created="2024-01-01", expires="2024-01-31"), fact(2, created="2024-03-01", expires="2024-05-01"),
         fact(3, created="2024-06-01", expires="2024-08-01")], FACT
    ).withColumn("part", F.col("id") - 1)
    folder = landed(df, tmp_path, "facts", 3)
    schema = spark.createDataFrame([], FACT).schema
    stream = runs.file_stream(spark, folder, df.schema, files_per_trigger=1)
    keeper = runs.fact_keeper(str(tmp_path / "state"), schema)
    query = runs.run_batches(stream, keeper, str(tmp_path / "cp"))
    assert query.lastProgress["batchId"] == 2
    now = F.lit("2024-06-01").cast(schema["created_at"].dataType)
    assert [r.id for r in runs.current_facts(spark, str(tmp_path / "state"), schema, now).collect()] == [3]


def test_stream_outcomes_split_by_known_day(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(10)]
    prices = spark.createDataFrame([("A", d, float(i + 1)) for i, d in enumerate(days)], "ticker string, date date, close double")
    panel = materialise(forward_returns(prices, [2]), "t")
    until = ["2024-01-05", "2024-01-08"]
    write = runs.outcome_writer(str(tmp_path), panel, 2, lambda batch: F.lit(until[batch]).cast("date"))
    signals = spark.createDataFrame([("A", d) for d in days + [dt.date(2025, 1, 1)]], "ticker string, date date")
    write(signals, 0)
    known = lambda: sorted((r.batch, r.date.day) for r in runs.batches(spark, f"{tmp_path}/known").collect())
    assert known() == [(0, 1), (0, 2), (0, 3)]
    assert runs.open_signals(spark, str(tmp_path), signals.schema, 0).count() == 8
    for _ in range(2):
        write(signals.limit(1), 1)
        assert known() == [(0, 1), (0, 2), (0, 3), (1, 1), (1, 4), (1, 5), (1, 6)]
        assert runs.open_signals(spark, str(tmp_path), signals.schema, 1).count() == 5
