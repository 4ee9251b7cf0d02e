"""Periodic runs against a search of all stretches."""

import hashlib
import os
import random
import zlib

import pytest

from tidemark.llm import repeats
from tidemark.llm.periodic_runs import collapsed, find_runs, runs_of, word_codes

SF_DIR = "/root/testdata/sf0.001"


def smallest_period(part):
    return next(q for q in range(1, len(part) + 1) if part[q:] == part[: len(part) - q])


def brute(words):
    """All (start, length, period), from every maximal stretch of every lag."""
    out, n = [], len(words)
    for q in range(1, n):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            if end > start and length >= max(6, 4 * q) and smallest_period(words[start : start + length]) == q:
                out.append((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(8)
    cases = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 70, list("ab" * 4), list("ab" * 3) + ["a"], list("aabaab" * 6)]
    for _ in range(400):
        words = []
        for _ in range(rng.randint(1, 6)):
            period = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
            words += (period * 9)[: rng.randint(1, 9 * len(period))]
        cases.append(words)
    cases += [[rng.choice("ab") for _ in range(rng.randint(1, 150))] for _ in range(300)]
    for words in cases:
        got = runs_of(word_codes(words))
        assert got == brute(words), words
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in got)]
        assert collapsed(words, got) == kept


def test_long_periods_and_long_texts_stay_fast():
    rng = random.Random(2)
    period = [str(rng.randint(0, 50)) for _ in range(4000)]
    words = ["x"] * 3000 + period * 5 + ["a", "b"] * 40_000
    got = runs_of(word_codes(words))
    assert (0, 3000, 1) in got and (23_000, 80_000, 2) in got
    assert any(n == 20_000 and q == 4000 for _, n, q in got)


def test_rows_as_they_come(spark):
    schema = "doc_id string, text string, runs string, collapsed map<string,int>, id int"
    texts = [None, "", " \t\n", "a", "a " * 8 + "b", "a b " * 7]
    docs = spark.createDataFrame([(k, t, "r", {"c": 1}, 0) for k in (None, "x", "x") for t in texts], schema)
    got = find_runs(docs).collect()
    assert len(got) == 18
    by_text = {r.collapsed: (r.n_words, [tuple(x) for x in r.runs]) for r in got if r.id is None and r.runs}
    assert by_text == {"a b": (9, [(0, 8, 1)]), "a b": (7, [(0, 7, 1)])}
    assert sorted(r.n_words for r in got if r.id == "x") == sorted([0, 0, 0, 1, 9, 7] * 2)
    assert find_runs(docs.limit(0)).collect() == []


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    return words


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in repeats.op12_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = planted(doc_id, text)
        # Brute force takes the square of the length.
        runs = brute(words) if len(words) < 1500 else runs_of(word_codes(words))
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        row = got[doc_id]
        assert (row.n_runs, row.runs_sha256) == (len(runs), hashlib.sha256(lines.encode()).hexdigest())
        expected = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        assert (row.start, row.length, row.period, row.exponent_milli) == expected
        kept = " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs))
        assert row.collapsed_sha256 == hashlib.sha256(kept.encode()).hexdigest()
