"""Quality measures by brute force, exact bounds, and rejection rates that hold."""

import random
import re
from math import comb

from tidemark.llm import quality, queries
from tidemark.llm.binomial import at_most

SF_DIR = "/root/testdata/sf0.001"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines), sum(line in lines[:i] for i, line in enumerate(lines)), len(repeated),
    )


def test_measures_match_brute_force():
    rng = random.Random(1)
    cases = [None, "", " ", "a", "a b", "a b c", "a a a a", "x\ny\nx\n \n \nx", "é 😀 #&|<>*$%", "a b c d\x0be\x1ff"]
    cases += ["".join(rng.choice("ab \n#é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in cases:
        assert quality.measures(text or "") == brute(text), text


def test_exact_binomial():
    for n, p in ((20, 0.1), (57, 0.03)):
        for k in range(n + 1):
            exact = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert abs(at_most(k, n, p) - exact) < 1e-12
    assert 0 < at_most(10, 500_000, 0.0001) < 1e-9


def test_strictest_cutoff():
    assert quality.strictest(0, [0, 0], 0.01, 0.01) is None
    assert quality.strictest(1000, [0, 0, 1, 300], 0.01, 0.01) == 2
    assert quality.strictest(1000, [0, 30, 0], 0.01, 0.01) == 0
    assert quality.strictest(100, [0], 0.01, 0.01) is None


def made(spark, good=3000, bad=800):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, labels = [], []
    for i in range(good + bad):
        junk = i >= good
        text = " ".join(word() + ("###" if junk else "") for _ in range(60))
        rows.append((i, text, ["en", "de"][i % 2], 1))
        labels.append((i, int(not junk)))
    rows += [(9001, None, None, 1), (9002, "", "xx", 1), (9003, "short text", "en", 1), (9003, "short text", "en", 1), (9004, rows[-1][1], "xx", 1)]
    labels += [(9004, None), (None, 1), (1, 0)]
    return (
        spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum int"),
        spark.createDataFrame(labels, "doc_id long, quality int"),
    )


def test_rules_reject_junk_and_hold_the_rate(spark):
    docs, labels = made(spark)
    rows = {r.id: r for r in quality.judge(docs, labels).collect()}
    assert len(rows) == 3804
    good = [rows[i] for i in range(3000)]
    for lang in ("en", "de"):
        lost = [not r.kept for r in good if r.stratum == lang]
        assert sum(lost) <= quality.FALSE_REJECTIONS * len(lost)
    assert not any(rows[i].kept for i in range(3000, 3800))
    assert not rows[9001].kept and rows[9001].base_failed and not rows[9003].kept
    # No labels, no proven cutoffs: the method rejects nothing there.
    assert rows[9004].kept and rows[9004].rejected_by == []


def test_filter_keeps_columns(spark):
    docs, labels = made(spark, 700, 50)
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert set(range(700)) - ids == set() and 9001 not in ids
    empty = quality.without_rejected(docs.limit(0), labels.limit(0))
    assert empty.count() == 0


def test_copies_are_one_trial_and_columns_may_clash(spark):
    rows = [(i, " ".join(f"t{i}w{j}" for j in range(60)), "en") for i in range(400)] + [(1000 + i, "### " * 60, "en") for i in range(400)]
    docs = spark.createDataFrame([(*r, 1, 2, {"a": 1}) for r in rows], "doc_id long, text string, lang string, rejected_id int, gone int, m map<string,int>")
    labels = spark.createDataFrame([(k, 1) for k, *_ in rows], "doc_id long, quality int")
    measured = quality.measure(docs)
    counted = {r.text_key for r in measured.collect()}
    assert len(counted) == 401
    # Four hundred copies of one bad text are one trial among 401, not half of them.
    cuts = quality.cutoffs(measured, labels, share=0.2).collect()
    assert [r.cut_symbols for r in cuts] == [quality.RULES["symbols"][1][-1]]
    kept = quality.without_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 400


def test_query_matches_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = queries.op6_quality(spark, SF_DIR).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, chars, symbols, lines, dups, repeats = brute(texts[r.doc_id])
        failed = n < 50 or 100 * repeats > 50 * n
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (n, chars, symbols, lines, dups, repeats, failed)
        assert r.kept == (not failed and not r.rejected_by)
