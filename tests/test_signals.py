"""Response shapes, labels and repair."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import signals as sg
from tidemark.sources import predictions as pr


def scores(spark, raw, unknown="zero"):
    df = spark.createDataFrame([(raw,)], "raw string").select(
        sg.strict_scores(sg.parse_response(F.col("raw")), unknown).alias("s")
    )
    found = df.collect()[0].s
    return None if found is None else {e.ticker: e.score for e in found}


@pytest.mark.parametrize(
    "raw,expected",
    [
        ('{"signal_vector": {"T1": 1.5}}', {"T1": 1.5}),
        ('{"signal_vector": {"T1": {"score": 1.5, "reasoning": "x"}, "T2": {}}}', {"T1": 1.5, "T2": 0.0}),
        ('{"signal_vector": {"T1": "slightly bearish", "T2": "+0.4", "T3": "n/a"}}', {"T1": 0.0, "T2": 0.4, "T3": 0.0}),
        ('{"signal_vector": [{"ticker": "T1", "score": 1}, {"ticker": "T1", "score": 2}, {"score": 3}, {"ticker": "T2"}]}', {"T1": 2.0, "T2": 0.0}),
        ('{"T1": 1.5, "T2": -0.4, "chain_of_thought": "why"}', {"T1": 1.5, "T2": -0.4, "chain_of_thought": 0.0}),
        ('Sure! ```not a fence {"signal_vector": {"T1": 1}} bye', {"T1": 1.0}),
        ('```json\n{"signal_vector": {"T1": 1}}\n```', {"T1": 1.0}),
        ('{"signal_vector": {"T1": null, "T2": true, "T3": [1]}}', {"T1": 0.0, "T2": 1.0, "T3": 0.0}),
        ('{"signal_vector": {"T1": {"score": "high"}}}', {"T1": None}),
        ("no json here", None),
        ('{"signal_vector": {"T1": 1', None),
    ],
)
def test_strict_shapes(spark, raw, expected):
    found = scores(spark, raw)
    assert (found or None) == expected


def test_loop_reading_drops_null_and_lists(spark):
    assert scores(spark, '{"signal_vector": {"T1": null, "T2": true, "T3": [1], "T4": "x"}}', "drop") == {"T2": 1.0, "T4": 0.0}


@pytest.mark.parametrize(
    "label,score",
    [
        ("bullish", 1.5), ("Slightly Bearish", -0.5), ("score: -0.75", -0.75), ("fairly moderately bullish", 1.5),
        ("unknown", 0.0), (" NEUTRAL ", 0.0), ("very bearish indeed", -1.5), ("+.5 maybe", 0.5), ("", 0.0),
    ],
)
def test_labels(spark, label, score):
    df = spark.createDataFrame([(label,)], "t string").select(sg.word_score(F.col("t")).alias("s"))
    assert df.collect()[0].s == score


def test_lenient_reads_signal_field_and_skips_null(spark):
    raw = '{"signal_vector": {"A": {"signal": "bullish"}, "B": {"score": "minor"}, "C": null, "D": [1], "E": {}, "F": "2"}}'
    df = spark.createDataFrame([(raw,)], "raw string").select(sg.lenient_scores(sg.parse_span(F.col("raw"))).alias("s"))
    assert {e.ticker: e.score for e in df.collect()[0].s} == {"A": 1.5, "B": 0.3, "E": 0.0, "F": 2.0}


def test_truncated_and_thinking(spark):
    raw = '<think>a {b}</think> {"signal_vector": {"A": 1}'
    row = (
        spark.createDataFrame([(raw,)], "raw string")
        .select(sg.split_thinking(F.col("raw")).alias("p"))
        .select("p.*", F.to_json(sg.parse_truncated(F.col("p.content"))).alias("j"))
        .collect()[0]
    )
    assert row.thinking == "a {b}" and json.loads(row.j) == {"signal_vector": {"A": 1}}
    open_tag = spark.createDataFrame([("<think>still going",)], "raw string").select(sg.split_thinking(F.col("raw")).alias("p"))
    assert open_tag.collect()[0].p.content == "<think>still going"


def test_served_container_order(spark):
    known = ["A", "B"]
    cases = {
        '{"signal_vector": {"X": 1}, "signals": {"Y": 1}}': ["X"],
        '{"signals": {"Y": 1}}': ["Y"],
        '{"signal_vector": {}, "A": 1, "B": "x", "C": 2}': ["A"],
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string").select(
        "raw", sg.served_entries(sg.parse_span(F.col("raw")), known).alias("e")
    )
    assert {r.raw: [x.ticker for x in r.e] for r in df.select("raw", F.transform("e", lambda x: F.struct(x["ticker"].alias("ticker"))).alias("e")).collect()} == cases


def test_recovery(spark):
    rows = [
        ("success", None, '{"signal_vector": {"A": "bullish"}}'),
        ("error", "could not convert string to float: 'x'", '{"signal_vector": {"A": {"score": "bearish"}}}'),
        ("error", "could not convert string to float: 'x'", '{"signal_vector": {"A": "neutral"}}'),
        ("error", "timeout", '{"signal_vector": {"A": "bullish"}}'),
        ("error", "could not convert string to float: 'x'", None),
    ]
    df = spark.createDataFrame(rows, "status string, error string, j string").withColumn("signal", F.try_parse_json("j"))
    got = sg.recover_predictions(df).select("status", "scores").collect()
    assert [r.status for r in got] == ["success", "recovered", "error", "error", "error"]
    assert got[1].scores[0].score == -1.5 and got[2].scores is None


def test_files_skip_or_fail(spark, tmp_path):
    path = tmp_path / "predictions_a.jsonl"
    path.write_text('{"status":"success","article_idx":1,"date":"2024-01-02"}\n\nbroken\n{"status":"error","article_idx":2}\n{"success":true,"article_idx":3}\n')
    rows = pr.read_predictions(spark, str(path))
    assert [r.article_idx for r in pr.successful(rows).collect()] == [1]
    assert [r.article_idx for r in pr.served(rows).collect()] == [3, 1]
    with pytest.raises(Exception):
        pr.read_predictions(spark, str(path), strict=True).collect()
    models = pr.read_models(spark, str(tmp_path), {"a": "predictions_a", "b": "predictions_b"})
    assert {r.config for r in models.collect()} == {"a"}


def test_lines_of_other_types_stay(spark, tmp_path):
    lines = [
        '{"status":"success","article_idx":"2","time_seconds":"1.5"}', '{"status":"success","article_idx":5.0}',
        '{"status":"success","article_idx":[1],"date":7}', '{"status":"success","success":"yes"}', "5", '"text"', "{broken",
    ]
    (tmp_path / "predictions_x.jsonl").write_text("\n".join(lines))
    (tmp_path / "predictions_xb.jsonl").write_text(lines[0])
    rows = pr.read_predictions(spark, str(tmp_path / "predictions_x.jsonl"))
    assert [r.article_idx for r in rows.collect()] == [2, 5, None, None]
    assert rows.count() == rows.select("article_idx").count() == rows.select("error").count() == 4
    assert rows.collect()[0].time_seconds == 1.5
    models = pr.read_models(spark, str(tmp_path), {"x": "predictions_x", "b": "predictions_xb"})
    assert {r.config: r["count"] for r in models.groupBy("config").count().collect()} == {"x": 4, "b": 1}


def test_metrics_file_absent(spark, tmp_path):
    assert pr.read_metrics(spark, str(tmp_path / "none")).count() == 0


def test_resume_retries_errors_unless_told_not_to(spark):
    articles = spark.createDataFrame([("c", i) for i in range(4)], "config string, article_idx long")
    written = spark.createDataFrame([("c", 0, "success"), ("c", 1, "error")], "config string, article_idx long, status string")
    left = lambda **k: sorted(r.article_idx for r in pr.remaining(articles, written, **k).collect())
    assert left() == [1, 2, 3]
    assert left(errors_count_as_done=True) == [2, 3]


def test_articles_and_appended_predictions(spark, tmp_path):
    articles = tmp_path / "articles.jsonl"
    articles.write_text("".join(f'{{"article_idx": {i}, "title": "t{i}", "date": "2024-01-0{i + 1}"}}\n' for i in range(4)))
    first = pr.read_articles(spark, str(articles), first=3)
    assert sorted(r.article_idx for r in first.collect()) == [0, 1, 2]
    out = str(tmp_path / "written")
    for status in ("success", "error"):
        rows = first.filter("article_idx = 0" if status == "success" else "article_idx = 1")
        pr.append_predictions(rows.select(F.lit("c").alias("config"), "article_idx", F.lit(status).alias("status")), out)
    written = spark.read.schema("config string, article_idx long, status string").json(out)
    left = pr.pending_work(first.drop("config"), ["c", "d"], written)
    assert sorted((r.config, r.article_idx) for r in left.collect()) == [("c", 1), ("c", 2), ("d", 0), ("d", 1), ("d", 2)]
