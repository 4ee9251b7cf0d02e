"""Contexts of many queries that mention the same tickers."""

from pyspark.sql import functions as F

from tidemark.operators import context as cx

AS_OF = "2024-06-01"


def memory(spark):
    facts = spark.createDataFrame(
        [(i, "ABC"[i % 3], f"fact {i} " + "x" * 200, i % 2) for i in range(12)], "id long, ticker string, content string, access_count long"
    ).withColumns({"updated_at": F.lit("2024-05-01").cast("timestamp_ntz"), "expires_at": F.lit("2024-07-01").cast("timestamp_ntz")})
    signals = spark.createDataFrame(
        [(i, "2024-03-01", f"title {i}", "correct", "ABC"[i % 3]) for i in range(6)],
        "id long, article_date string, article_title string, outcome string, ticker string",
    )
    accuracy = spark.createDataFrame([(3, 1, 0, 0.75)], "correct long, incorrect long, pending long, accuracy double")
    return facts, signals, accuracy, F.lit(AS_OF).cast("timestamp_ntz")


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, source string, tickers array<string>")


def test_equal_ticker_lists_are_packed_once(spark, monkeypatch):
    lists = [["A", "B"], ["C", "A", "B", "Z"], [], ["C", "A", "B"]]
    many, written, write = [(i, "s", lists[i % 4]) for i in range(200)], {}, cx.materialise

    def counted(df, name):
        out = write(df, name)
        written[name] = out.count()
        return out

    alone = [cx.semantic_context(asked(spark, [(1, "s", one)]), *memory(spark)).first().packed for one in lists]
    monkeypatch.setattr(cx, "materialise", counted)
    got = {r.query_id: r.packed for r in cx.semantic_context(asked(spark, many), *memory(spark)).collect()}
    assert got == {i: alone[i % 4] for i in range(200)} and alone[1] == alone[3] and "[MEMORY: C]" in alone[1]
    # Per list: the track record, three facts lines and two tickers' signals at most.
    assert written["sections"] <= 3 * (1 + 3 + 2 * 2)


def test_contexts_of_many_lists_and_odd_ids(spark, monkeypatch):
    rows = [(1, "s", ["A"]), (2, "s", None), (None, "s", ["B"])]
    few = sorted(map(str, cx.semantic_context(asked(spark, rows), *memory(spark)).collect()))
    monkeypatch.setattr(cx, "BROADCAST_CHARS", 0)
    assert sorted(map(str, cx.semantic_context(asked(spark, rows), *memory(spark)).collect())) == few
    got = {r.query_id: r.packed for r in cx.semantic_context(asked(spark, rows), *memory(spark)).collect()}
    assert got[None] == "" and "[MEMORY: A]" in got[1] and got[2].startswith("[YOUR TRACK RECORD]") and "\n" not in got[2]


def test_texts_of_sections_are_never_broadcast(spark):
    rows = spark.range(400).select(F.col("id").alias("k"), F.lit(1).alias("p"), F.repeat(F.lit("long "), F.lit(2000)).alias("t"))
    packed = cx.pack_sections(rows, "k", "p", "t", 20_000)
    assert "strategy=merge" in packed._jdf.queryExecution().optimizedPlan().toString()
    assert packed.filter("sections = 1 AND length(packed) = 10000").count() == 400
