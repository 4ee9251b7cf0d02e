"""Text, lexical memory, search, facts, rules and context."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions import text as t
from tidemark.operators import context, episodes, facts, rules, search
from tidemark.sources import dimensions, feeds
from tidemark.sources import memory as me


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    "text,tags",
    [("IONQ and RGTI moved on quantum news", ["IONQ", "RGTI"]), ("IONQ.", []), ("$ionq up", ["IONQ"]), ("", [])],
)
def test_tags(spark, text, tags):
    assert one(spark, t.ticker_tags(t.tokens(F.col("x")), fixed.TICKERS), x=text) == tags


def test_token_quirks(spark):
    assert sorted(one(spark, t.tokens(F.col("x")), x="A a. $$ B-c $d")) == ["", "a", "a.", "b-c", "d"]


def test_mentions(spark):
    token = t.mentioned_tickers(F.col("x"), fixed.TICKERS, fixed.NAME_ALIASES, fixed.PURE_PLAY_TICKERS)
    substring = t.mentioned_tickers(
        F.col("x"), fixed.TICKERS, fixed.SUBSTRING_NAME_ALIASES, fixed.PURE_PLAY_TICKERS, mode="substring"
    )
    assert one(spark, token, x="Python and Rigetti, IONQ") == ["IONQ", "RGTI"]
    assert one(spark, substring, x="Python and IonQ") == ["IONQ", "HON", "IonQ"]
    assert one(spark, token, x="nothing") == fixed.PURE_PLAY_TICKERS


def test_keyword_ticker_and_levels(spark):
    assert one(spark, t.first_keyword_ticker(F.col("x")), x="Annealing by Google") == "QBTS"
    assert one(spark, t.first_keyword_ticker(F.col("x")), x="plain") == "IONQ"
    assert one(spark, t.paper_significance(F.col("x")), x="A Fault-Tolerant novel thing") == "high"
    assert one(spark, t.paper_significance(F.col("x")), x="A novel thing") == "medium"
    assert one(spark, t.paper_significance(F.col("x")), x="A thing") == "low"


@pytest.mark.parametrize(
    "published,day",
    [
        ("Mon, 05 Jan 2026 23:30:00 GMT", dt.date(2026, 1, 5)),
        ("Mon, 05 Jan 2026 23:30:00 -0500", dt.date(2026, 1, 5)),
        ("5 Jan 2026 01:00:00 +0200", dt.date(2026, 1, 5)),
        ("soon", dt.date(2030, 1, 1)),
    ],
)
def test_feed_date(spark, published, day):
    assert one(spark, t.feed_date(F.col("x"), F.lit("2030-01-01").cast("date")), x=published) == day


def test_strip_and_sign(spark):
    assert one(spark, t.strip(F.col("x")), x=" \t a b \n ") == "a b"
    assert one(spark, t.signed(F.col("x").cast("double"), 1), x="0.25") == "+0.2"
    assert one(spark, t.whole_percent(F.col("x").cast("double")), x="0.725") == "72"


def test_content_id_matches_hash(spark):
    import hashlib

    expected = hashlib.sha256("\n".join(["news", "T", "2024-01-01", "body"]).encode()).hexdigest()[:16]
    got = one(spark, t.content_id(F.col("s"), F.col("t"), F.col("o"), F.col("b")), s="news", t="T", o="2024-01-01", b=" body ")
    assert got == expected


def note(text, title="", seq=0, source="manual_note", day="2024-01-01"):
    return (text, source, title, "", day, "{}", seq)


NOTE = "text string, source string, title string, url string, observed_at string, metadata string, seq long"


def test_existing_record_wins_and_batch_is_deduplicated(spark):
    stored = me.to_records(spark.createDataFrame([note("same", seq=1)], NOTE), fixed.TICKERS).withColumn("url", F.lit("old"))
    new = me.to_records(spark.createDataFrame([note(" same ", seq=2), note("b", seq=3), note("b", seq=4)], NOTE), fixed.TICKERS)
    merged = {r.text: r for r in me.add_records(new, stored).collect()}
    assert set(merged) == {"same", "b"} and merged["same"].url == "old"
    assert [r.seq for r in me.new_records(new, stored).collect()] == [3]


def test_given_tags_are_kept(spark):
    df = spark.createDataFrame([note("IONQ news")], NOTE).withColumn("tags", F.array(F.lit("X")))
    assert me.to_records(df, fixed.TICKERS).collect()[0].tags == ["X"]


def test_golden_search(spark):
    notes = [note("IonQ announced a trapped-ion error correction milestone.", "IonQ milestone"), note("Bananas are yellow", "Fruit", 1)]
    records = me.to_records(spark.createDataFrame(notes, NOTE), fixed.TICKERS)
    queries = spark.createDataFrame([(1, "Does this IonQ error correction update matter?"), (2, "???")], "query_id long, text string")
    hits = search.lexical_search(queries, records, fixed.TICKERS).collect()
    titles = {r.record_id: r.title for r in records.collect()}
    assert [(h.query_id, titles[h.record_id], h.score) for h in hits] == [(1, "IonQ milestone", 6)]


def python_tokens(text):
    return {x.lower().lstrip("$") for x in re.findall(fixed.TOKEN_PATTERN, text)}


@pytest.mark.parametrize("common_share", [0.0, 0.1, 0.5, 1.0])
def test_search_equals_full_scan_whatever_is_common(spark, common_share):
    """One word sits in a third of the records, one in all of them."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(30)] + ["ionq", "rgti"]
    records = []
    for i in range(120):
        body = rng.sample(words, 5) + ["every"] + (["hot"] if i % 3 == 0 else [])
        records.append((str(i), dt.date(2024, 1, 1 + i % 20), i, " ".join(body)))
    queries = [(q, " ".join(rng.sample(words, rng.randint(0, 6)) + ["every", "hot"])) for q in range(12)] + [(99, "absent")]
    df = spark.createDataFrame(records, "record_id string, observed_at date, seq long, text string")
    got = search.lexical_search(
        spark.createDataFrame(queries, "query_id long, text string"), df, fixed.TICKERS, 5, F.col("text"), common_share
    ).collect()
    expected = []
    for q, text in queries:
        wanted = python_tokens(text)
        scored = []
        for rid, day, seq, body in records:
            shared = wanted & python_tokens(body)
            score = len(shared) + 3 * len(shared & {x.lower() for x in fixed.TICKERS})
            if score:
                scored.append((-score, -day.toordinal(), seq, rid))
        expected += [(q, rid, -s, pos + 1) for pos, (s, _, _, rid) in enumerate(sorted(scored)[:5])]
    assert sorted((r.query_id, r.record_id, r.score, r.pos) for r in got) == sorted(expected)


def test_prompt_without_memory(spark):
    queries = spark.createDataFrame([(1, "news", "hello")], "query_id long, source string, text string")
    blocks = spark.createDataFrame([], "query_id long, memory_block string")
    assert fixed.NO_MEMORY_TEXT in context.prompts(queries, blocks).collect()[0].prompt


# --- rules ------------------------------------------------------------------------------------
def outcomes(spark, rows):
    """(ticker, source, direction, hits, misses) as episodes."""
    out = []
    for ticker, source, direction, hits, misses in rows:
        out += [(ticker, source, direction, True)] * hits + [(ticker, source, direction, False)] * misses
    return spark.createDataFrame(out, "ticker string, source string, predicted_direction string, was_correct boolean")


def rule_map(spark, rows):
    made = rules.generate_rules(outcomes(spark, rows), F.lit("2024-01-01"))
    return {r.rule_id: r for r in made.collect()}


def test_golden_small_set_gives_one_rule(spark):
    made = rule_map(spark, [
        ("IONQ", "news", "bullish", 5, 1), ("RGTI", "news", "bearish", 1, 1), ("QBTS", "news", "bullish", 1, 1),
        ("RGTI", "arxiv", "bearish", 0, 1), ("QBTS", "arxiv", "bearish", 0, 1), ("IONQ", "arxiv", "bullish", 0, 1),
        ("QNT", "press_release", "bullish", 1, 0), ("RGTI", "sec_filing", "bearish", 1, 0),
    ])
    assert set(made) == {"source_strong_news"}
    rule = made["source_strong_news"]
    assert (rule.confidence, rule.evidence_count, rule.category) == (0.7, 10, "source_bias")
    assert "70% accurate (10 observations)" in rule.rule_text


def test_every_family_and_cap(spark):
    made = rule_map(spark, [("A", "s1", "bullish", 20, 0), ("B", "s2", "bearish", 2, 18)])
    assert {k: round(v.confidence, 4) for k, v in made.items()} == {
        "source_strong_s1": 0.95, "source_weak_s2": 0.9, "ticker_strong_A": 0.95, "ticker_weak_B": 0.9,
        "direction_bullish_reliable": 1.0, "direction_bearish_unreliable": 0.9, "overall_calibration": 0.9,
    }
    assert "well-calibrated" in made["overall_calibration"].rule_text


@pytest.mark.parametrize("hits,misses,word", [(9, 11, "overconfident"), (10, 10, "strong predictive"), (11, 9, "well-calibrated"), (15, 5, "strong predictive")])
def test_overall_verdict(spark, hits, misses, word):
    assert word in rule_map(spark, [("A", "s", "neutral", hits, misses)])["overall_calibration"].rule_text


def test_upsert_keeps_creation_and_category(spark):
    schema = "rule_id string, rule_text string, confidence double, evidence_count long, created_at string, last_validated string, category string"
    old = spark.createDataFrame([("a", "old", 0.6, 1, "t0", "t0", "x"), ("b", "keep", 0.7, 2, "t0", "t0", "y")], schema)
    new = spark.createDataFrame([("a", "new", 0.8, 5, "t1", "t1", "z"), ("c", "add", 0.9, 3, "t1", "t1", "z")], schema)
    got = {r.rule_id: tuple(r)[1:] for r in rules.upsert_rules(old, new).collect()}
    assert got == {
        "a": ("new", 0.8, 5, "t0", "t1", "x"), "b": ("keep", 0.7, 2, "t0", "t0", "y"), "c": ("add", 0.9, 3, "t1", "t1", "z"),
    }


def test_rule_history_uses_earlier_batches_only(spark):
    rows = [("c", b, "A", "s", "bullish", b < 2) for b in range(4) for _ in range(10)]
    seen = spark.createDataFrame(rows, "config string, batch long, ticker string, source string, predicted_direction string, was_correct boolean")
    history = {(r.batch, r.rule_id): r for r in rules.rule_history(seen, ["config"]).collect()}
    assert history[(0, "ticker_strong_A")].evidence_count == 10 and history[(0, "ticker_strong_A")].usable_from == 1
    assert history[(2, "ticker_strong_A")].confidence == pytest.approx(2 / 3)
    assert (3, "ticker_strong_A") not in history


def test_model_rules_defaults(spark):
    text = 'x [{"rule_id": "r", "confidence": 0.7}, {"rule_text": "t"}] y'
    df = spark.createDataFrame([(1, 30, text), (2, 30, "none")], "batch long, evidence_count long, response string")
    got = sorted((r.rule_id, r.rule_text, r.confidence, r.category) for r in rules.rules_from_responses(df, F.lit("t")).collect())
    assert got == [("model_rule_1_1", "t", 0.6, "pattern"), ("r", "", 0.7, "pattern")]


# --- facts ------------------------------------------------------------------------------------
def ts(text):
    return dt.datetime.fromisoformat(text)


def fact(i, ticker="A", created="2024-05-20", expires="2024-07-01", used=1, content="c"):
    return (i, ticker, "t", content, "s", 1.0, ts(created), ts(created), ts(expires), used, None)


FACT = (
    "id long, ticker string, fact_type string, content string, source string, confidence double, created_at timestamp_ntz, "
    "updated_at timestamp_ntz, expires_at timestamp_ntz, access_count long, last_accessed timestamp_ntz"
)
NOW = "2024-06-01"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def test_fates_and_strict_bounds(spark):
    df = spark.createDataFrame([
        fact(1, expires="2024-05-31"), fact(2, expires=NOW), fact(3, created="2024-05-01", used=0),
        fact(4, created="2024-05-02", used=0), fact(5, created="2024-01-01", used=1),
    ], FACT)
    assert {r.id: r.fate for r in facts.with_fate(df, now()).collect()} == {1: "expired", 2: "kept", 3: "pruned", 4: "kept", 5: "kept"}
    assert sorted(r.id for r in facts.live_facts(df, now()).collect()) == [3, 4, 5]


def test_accesses(spark):
    df = spark.createDataFrame([fact(1, used=2), fact(2, used=0)], FACT)
    log = spark.createDataFrame([(1, ts("2024-05-01")), (1, ts("2024-05-03"))], "fact_id long, at timestamp_ntz")
    got = {r.id: (r.access_count, r.last_accessed) for r in facts.with_accesses(df, log).collect()}
    assert got == {1: (4, ts("2024-05-03")), 2: (0, None)}


def test_contradiction_touches_latest_five_only(spark):
    df = spark.createDataFrame([fact(i, created=f"2024-05-{10 + i}") for i in range(7)], FACT)
    updates = spark.createDataFrame([(100, "A", "new", "s")], "id long, ticker string, content string, source string")
    got = {r.id: r.confidence for r in facts.apply_contradictions(df, updates, now(), lambda o, n: F.lit(True)).collect()}
    assert got == {0: 1.0, 1: 1.0, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5, 6: 0.5, 100: 1.0}
    assert facts.apply_contradictions(df, updates, now()).filter("confidence < 1").count() == 0


def test_weekly_needs_ten(spark):
    rows = [(i, dt.date(2024, 1, 1), 1.0) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, article_date date, score double")
    as_of = F.lit(NOW).cast("date")
    assert facts.weekly_summaries(df, as_of).count() == 0
    assert facts.weekly_summaries(df.unionByName(df), as_of).collect()[0].signals == 18


def test_seed_and_sector(spark):
    assert dimensions.seed_facts(spark).count() == 12
    assert dimensions.sector_text(spark).collect()[0].text.count("\n") == 19
    assert dimensions.sector_clusters(spark).filter("cluster = 'Trapped Ion'").collect()[0].tickers == ["HON", "IONQ", "QNT"]


# --- context ----------------------------------------------------------------------------------
@pytest.mark.parametrize("limit,kept", [(6, 2), (5, 1), (2, 0), (100, 3)])
def test_packing(spark, limit, kept):
    df = spark.createDataFrame([(1, 0, "aaa"), (1, 1, "bb"), (1, 2, "cccc")], "k long, p long, s string")
    row = context.pack_sections(df, "k", "p", "s", limit).collect()[0]
    assert row.sections == kept and row.packed == "\n".join(["aaa", "bb", "cccc"][:kept])


def test_track_record_absent_without_outcomes(spark):
    empty = spark.createDataFrame([(0, 0, 0.0)], "correct long, incorrect long, accuracy double")
    assert context.track_record(empty).count() == 0


def test_accuracy_counts_of_nothing(spark):
    row = episodes.accuracy_counts(spark.createDataFrame([(None,)], "was_correct boolean")).collect()[0]
    assert (row.correct, row.incorrect, row.pending, row.accuracy) == (0, 0, 1, 0.0)


def test_unknown_source_is_empty(spark):
    rows = spark.createDataFrame([("news",)], "source_type string")
    assert feeds.one_source(rows, "nope").count() == 0
