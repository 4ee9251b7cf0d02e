"""Spelling variants against a comparison of all words, and the query against its SQL."""

import os
import random
from collections import Counter

import pytest

from tests.oracle import compare, connect
from tidemark.llm import repeats, spelling

SF_DIR = "/root/testdata/sf0.001"


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words, least_chars=6, least_times=5, ratio=5):
    count = {w: n for w, n in Counter(words).items() if w is not None and len(w) >= least_chars and n >= least_times}
    near = {w: [o for o in count if one_apart(w, o)] for w in count}
    best = {w: min(near[w], key=lambda o: (-count[o], o), default=None) for w in count}
    form = {w: best[w] if best[w] and count[best[w]] >= ratio * count[w] else None for w in count}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), count[w], len(near[w]), count.get(form[w])) for w in count)


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    bases = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 8))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaab", "ababab", "babababa"]
    words = [None, "", "abc"]
    for i, base in enumerate(bases):
        words += [base] * rng.choice([5, 6, 25, 26, 125, 700])
        for _ in range(3):
            at = rng.randrange(len(base))
            changed = rng.choice([base[:at] + base[at + 1 :], base[:at] + "z" + base[at:], base[:at] + "b" + base[at + 1 :]])
            words += [changed] * rng.choice([1, 5, 30])
    df = spark.createDataFrame([(w, "p", 1) for w in words], "word string, prefix string, n int").repartition(4)
    got = sorted(tuple(r) for r in spelling.variants(df).select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert got == brute(words)
    assert any(form and root != form for _, form, root, *_ in got)
    assert spelling.variants(df.limit(0)).collect() == []


def test_letters_and_lower_case(spark):
    docs = spark.createDataFrame(
        [(1, "ÀBC déf-GHI'x Łódź", 0), (1, "ÀBC déf-GHI'x Łódź", 0), (None, None, 0), (2, "", 0)], "doc_id long, text string, word int"
    )
    got = Counter(r.word for r in spelling.words_of(docs).collect())
    assert got == Counter({"Àbc": 2, "déf": 2, "ghi": 2, "x": 2, "ód": 2})


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
def test_query_matches_sql_and_brute_force(spark):
    df = repeats.op13_spelling_variants(spark, SF_DIR)
    result = connect(SF_DIR).execute(repeats.OP13_SQL)
    columns = [d[0] for d in result.description]
    rows = [tuple(r) for r in df.collect()]
    assert rows and compare(rows, df.columns, result.fetchall(), columns) is None
    words = [r.word for r in repeats.spelt(spark.read.parquet(f"{SF_DIR}/documents.parquet")).collect()]
    assert sorted(rows, key=lambda r: r[0]) == brute(words)
