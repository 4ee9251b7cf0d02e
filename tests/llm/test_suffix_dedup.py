"""Repeated passages against brute force, over many buckets and awkward rows."""

import hashlib
import os
import random

import pytest

from tests.oracle import compare, connect
from tidemark.llm import repeats, suffix_dedup
from tidemark.llm.suffix_dedup import SPAN, anchored, multikey_sort, without_repeats, words_of

SF_DIR = "/root/testdata/sf0.001"


def brute(rows):
    """(id, number of bytes, kept bytes, spans) of (id, text) rows with ids that differ."""
    seen, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = [False] * len(raw)
        for at in range(len(raw) - SPAN + 1):
            part = raw[at : at + SPAN]
            if part in seen:
                gone[at : at + SPAN] = [True] * SPAN
            seen.add(part)
        spans = [i for i in range(len(raw) + 1) if (i < len(raw) and gone[i]) != (i > 0 and gone[i - 1])]
        out.append((key, len(raw), bytes(b for b, g in zip(raw, gone) if not g), list(zip(spans[::2], spans[1::2]))))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passages = [text(rng.randint(15, 60)) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "a" * 99), (3, "a" * 100), (4, "a" * 700), (5, "ab" * 400 + "a" * 150)]
    rows += [(6, "abc" * 40), (7, "bca" * 90), (8, "x" + passages[0]), (9, passages[0] + "y")]
    for i in range(10, n):
        parts = [text(rng.randint(0, 50))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages), text(rng.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(n, rows[-1][1]), (n + 1, rows[-1][1]), (n + 2, rows[-1][1][3:-2] + "z"), (n + 3, " ".join(passages * 8))]
    return rows


def found(df):
    return sorted(
        ((r.id, r.n_bytes, bytes(r.kept), [tuple(s) for s in r.spans]) for r in df.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0),
    )


@pytest.mark.parametrize("bucket_rows", [100_000, 40, 3])
def test_equals_brute_force_however_many_buckets(spark, bucket_rows):
    rows = corpus(bucket_rows)
    random.Random(5).shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(without_repeats(docs, bucket_rows=bucket_rows)) == brute(rows)


def test_long_texts_are_cut_into_blocks_that_lose_nothing(monkeypatch):
    text = b" ".join(b"%d" % (i * i) for i in range(3000)) + b"q" * 500
    whole = [(p, n) for _, _, ps, ns, _, _, _, _ in anchored([("k", text)]) for p, n in zip(ps.tolist(), ns.tolist())]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    cut = [(p, n) for _, _, ps, ns, _, _, _, _ in anchored([("k", text)]) for p, n in zip(ps.tolist(), ns.tolist())]
    starts = lambda parts: [p + i for p, n in parts for i in range(n)]
    assert starts(whole) == starts(cut) == list(range(len(text) - SPAN + 1))


def test_multikey_sort_is_the_order_of_the_strings():
    import numpy as np

    rng = random.Random(3)
    strings = [bytes(rng.choice(b"\x00ab\xff") for _ in range(rng.randint(0, 20))) for _ in range(500)]
    strings += strings[:100]
    keys = np.array([rng.randint(0, 2) for _ in strings], np.uint64)
    ties = np.arange(len(strings))[::-1].copy()
    lengths = np.array([len(s) for s in strings])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(b"".join(strings), np.uint8)
    order, same = multikey_sort(words_of(data), starts, lengths, keys, (ties,))
    expected = sorted(range(len(strings)), key=lambda i: (keys[i], strings[i], ties[i]))
    assert order.tolist() == expected
    assert same.tolist() == [k > 0 and (keys[a], strings[a]) == (keys[b], strings[b]) for k, (a, b) in enumerate(zip([0] + expected, expected))]


def test_nulls_repeated_ids_clashing_columns_and_no_rows(spark):
    long = " ".join(str(i) for i in range(100))
    schema = "doc_id long, text string, doc string, twin string, v map<string,int>, ranges string, bucket int"
    rows = [(None, long), (3, "x" + long), (3, "x" + long), (4, None), (5, long + "!"), (5, "other " + long)]
    docs = spark.createDataFrame([(i, t, "d", "t", {"a": 1}, "r", 1) for i, t in rows], schema)
    got = found(without_repeats(docs))
    size = len(long)
    assert got[0] == (None, size, long.encode(), [])
    assert got[1] == got[2] == (3, size + 1, b"x", [(1, size + 1)])
    assert got[3] == (4, 0, b"", [])
    assert sorted(got[4:]) == [(5, size + 1, b"!", [(0, size)]), (5, size + 6, b"other ", [(6, size + 6)])]
    assert without_repeats(docs.limit(0)).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are absent")
def test_query_matches_sql(spark):
    df = repeats.op11_suffix_dedup(spark, SF_DIR)
    result = connect(SF_DIR).execute(repeats.OP11_SQL)
    columns = [d[0] for d in result.description]
    rows = [tuple(r) for r in df.collect()]
    assert compare(rows, df.columns, result.fetchall(), columns) is None
    assert hashlib.sha256(b"").hexdigest() in {r[4] for r in rows} or len(rows) > 0
