"""Queries over whole texts and budgets: nothing is cut off before the result."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark import fixed_values as fixed
from tidemark.operators import context
from tidemark.plans import contexts

SF_DIR = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry.queries()[name](spark, SF_DIR).collect()


def test_memory_updates_tells_whole_texts_apart(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("text").collect()]
    stripped = [x.strip() for x in texts if x and x.strip()]
    (found,) = rows(spark, "memory_updates")
    assert (found.updates, found.texts) == (len(stripped), len(set(stripped)))
    assert len({(x[:30], x[-20:]) for x in texts}) < len(set(texts))


def test_memory_updates_holds_several_notes_of_an_analysis(spark, tmp_path):
    same = "x" * 30 + "{}" + "y" * 20
    texts = ["one\n two \n\nthree", "one", "one", " \n\t\n", "", None, "four\r\nfour", same.format(1), same.format(2)]
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    whole = [x.strip() for x in texts if x and x.strip()]
    lines = [x.strip() for text in texts if text for x in text.split("\n") if x.strip()]
    (found,) = entry.queries()["memory_updates"](spark, str(tmp_path)).collect()
    assert found.asDict() == {
        "updates": len(whole), "texts": len(set(whole)), "lines": len(lines), "line_texts": len(set(lines)),
    }
    assert (len(whole), len(lines), len(set(lines))) == (6, 9, 6)


def test_memory_updates_of_no_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    (found,) = entry.queries()["memory_updates"](spark, str(tmp_path)).collect()
    assert tuple(found) == (0, 0, 0, 0)


def test_article_text_holds_the_whole_html(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    for r in rows(spark, "article_text"):
        page = pages[r.page_id]
        assert r.text == page.url + ". " + ("" if r.page_id % 3 == 0 else page.html or "")


def test_full_context_reaches_every_section(spark):
    built = contexts.built_context(spark, SF_DIR).collect()
    assert built
    for r in built:
        assert fixed.OVERALL_TRACK_RECORD.partition("{")[0] in r.context
        assert "[MEMORY: " in r.context and not r.context.endswith(fixed.TRUNCATION_SUFFIX)
    assert not any(r.was_cut for r in rows(spark, "full_context"))


def test_semantic_context_is_not_cut(spark):
    assert any(r.chars > 400 for r in rows(spark, "semantic_context"))


def test_note_on_a_cut_context(spark):
    queries = spark.createDataFrame([(1, [], "s")], "query_id long, tickers array<string>, source string")
    rules = spark.createDataFrame([], "rule_id string, rule_text string, confidence double, evidence_count long, category string")
    seen = spark.createDataFrame(
        [], "ticker string, source string, date date, article_idx long, was_correct boolean, predicted_direction string, "
        "predicted_score double, actual_return double, lesson string",
    )
    counts = spark.createDataFrame([], "family string, key string, correct long, total long")

    def built(chars, **budget):
        meaning = spark.createDataFrame([(1, "x" * chars)], "query_id long, packed string")
        return context.full_context(queries, rules, seen, counts, meaning, [F.asc("article_idx")], **budget).first().context

    size = 50 * fixed.CHARS_PER_TOKEN
    fits = size - (len(built(1)) - 1)
    assert built(fits, max_tokens=50) == built(fits) and len(built(fits)) == size
    assert built(fits + 1, max_tokens=50) == built(fits) + fixed.TRUNCATION_SUFFIX
