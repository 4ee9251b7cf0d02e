"""Prompt lines hold whole texts and titles unless a width is passed."""

import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import context


def test_memory_block_is_whole_by_default(spark):
    hits = spark.createDataFrame([(1, 7, 1)], "query_id long, record_id long, pos int")
    records = spark.createDataFrame([(7, "t", "s", "x" * 2000)], "record_id long, title string, source string, text string")
    assert context.memory_block(hits, records).first().memory_block == "- [7] t: " + "x" * 2000
    assert context.memory_block(hits, records, chars=800).first().memory_block == "- [7] t: " + "x" * 800


def test_episode_titles_are_whole_by_default(spark):
    seen = spark.createDataFrame(
        [(dt.date(2024, 1, 2), "A", "bullish", 1.0, "bullish", 0.1, True, "s", "y" * 90)],
        "date date, ticker string, predicted_direction string, predicted_score double, actual_direction string, "
        "actual_return double, was_correct boolean, source string, title string",
    )
    assert context.episode_prompt_lines(seen, [F.asc("ticker")]).first().line.endswith("Article: " + "y" * 90)
    assert context.episode_prompt_lines(seen, [F.asc("ticker")], title_chars=50).first().line.endswith(": " + "y" * 50)
