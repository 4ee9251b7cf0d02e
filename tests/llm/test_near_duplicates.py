"""Near-duplicate components against brute force over all pairs."""

import random

import pytest

from tests.oracle import connect
from tidemark.llm import components, near_duplicates, queries
from tidemark.llm.binomial import at_most, largest_threshold

SF_DIR = "/root/testdata/sf0.001"


def sets(text, words):
    terms = [t for t in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\x0b\x0c\r"}).split(" ") if t]
    if not terms:
        return frozenset()
    span = min(words, len(terms))
    return frozenset(tuple(terms[i : i + span]) for i in range(len(terms) - span + 1))


def brute(docs, words, similarity):
    made = {}
    for i, text in docs:
        made.setdefault(i, set()).add(sets(text, words))
    ids = sorted(made)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, i in enumerate(ids):
        for j in ids[:x]:
            if any(a and b and 100 * len(a & b) >= similarity * len(a | b) for a in made[i] for b in made[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def copies(seed, groups, most):
    """Texts in groups of near copies, the largest a chain that drifts away from its start."""
    rng = random.Random(seed)
    docs = []
    for g in range(groups):
        words = [f"g{g}w{rng.randrange(500)}" for _ in range(rng.choice([3, 20, 120]))]
        for _ in range(most if g == 0 else rng.randint(1, 6)):
            docs.append((len(docs) * 7 + 3, " ".join(words) if rng.random() < 0.8 else " ".join(words).upper().replace(" ", "\n")))
            words = list(words)
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("words,similarity", [(3, 85), (5, 80)])
def test_components_match_brute_force(spark, words, similarity):
    docs = copies(words, 40, 60) + [(1001, None), (1002, ""), (1003, " \n"), (1004, "one"), (1005, "ONE"), (1006, "one two")]
    table = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, root string")
    got = {r.id: r.component for r in near_duplicates.find_duplicates(table, words, similarity).collect()}
    assert got == brute(docs, words, similarity)


def test_large_lists_and_groups_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LIST_ROWS", 8)
    monkeypatch.setattr(near_duplicates, "GROUP_ROWS", 8)
    docs = copies(9, 4, 150)
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.id: r.component for r in near_duplicates.find_duplicates(table, 3, 85).collect()}
    assert got == brute(docs, 3, 85)


def test_a_long_list_of_unrelated_rows_never_meets(spark, monkeypatch):
    """Twenty thousand texts on one list, with two that belong together: rows compared stay few."""
    import numpy as np

    rng, n = np.random.default_rng(1), 20_000
    values = rng.integers(0, 1 << 16, (n, near_duplicates.COORDINATES), dtype=np.uint16)
    values[1] = values[0]
    values[1][:20] += 1
    rows = spark.createDataFrame([(1, n, i, v.tobytes()) for i, v in enumerate(values)], "key long, size long, doc long, payload binary")
    dealt = []
    blocks = near_duplicates.in_blocks
    monkeypatch.setattr(near_duplicates, "in_blocks", lambda rows, link: (dealt.append(rows), blocks(rows, link))[1])
    edges = near_duplicates.joined(
        rows, lambda *block: near_duplicates.match_rows(*block, 40), 512, near_duplicates.coordinate_groups(40)
    )
    assert {(min(r.a, r.b), max(r.a, r.b)) for r in edges.collect()} == {(0, 1)}
    assert sum(d.count() for d in dealt) < 3 * n


def test_finer_keys_are_shared_by_all_that_link():
    import numpy as np

    rng, groups = np.random.default_rng(5), near_duplicates.coordinate_groups(40)
    for _ in range(300):
        a = rng.integers(0, 9, near_duplicates.COORDINATES, dtype=np.uint16)
        b = a.copy()
        b[rng.permutation(len(a))[:24]] += 1
        assert set(groups(a.tobytes())) & set(groups(b.tobytes()))


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (9, "A b c d"), (7, None)], "doc_id int, text string")
    rows = sorted((r.id or -1, r.n_shingles, r.component or -1) for r in near_duplicates.find_duplicates(docs, 3, 85).collect())
    assert rows == [(-1, 2, -1), (5, 2, 5), (5, 2, 5), (7, 0, 7), (9, 2, 5)]
    assert near_duplicates.find_duplicates(docs.limit(0)).count() == 0
    kept = near_duplicates.without_duplicates(docs, 3, 85)
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["5", "5", "7", "None"]


def test_rows_that_repeat_an_id_are_one_document(spark):
    texts = {"A": "a b c d e", "B": "k l m n o", "C": "u v w x y"}
    rows = [(1, "A"), (1, "B"), (0, "A"), (5, "B"), (7, "C"), (7, "C"), (8, "C"), (9, None), (9, None), (None, "C"), (2, "z z z")]
    docs = spark.createDataFrame([(k, texts.get(t, t)) for k, t in rows], "doc_id long, text string")
    got = sorted(((r.id, r.n_shingles, r.component) for r in near_duplicates.find_duplicates(docs, 3, 85).collect()), key=str)
    expected = [(0, 3, 0), (1, 3, 0), (1, 3, 0), (5, 3, 0), (7, 3, 7), (7, 3, 7), (8, 3, 7), (9, 0, 9), (9, 0, 9), (None, 3, None), (2, 1, 2)]
    assert got == sorted(expected, key=str)


def test_clashing_columns_and_maps(spark):
    docs = spark.createDataFrame(
        [(2, "a b c d", 1, 1, {"k": 1}), (1, "a b c d", 1, 1, {"k": 2})],
        "doc_id long, text string, dropped_id int, gone int, root map<string,int>",
    )
    kept = near_duplicates.without_duplicates(docs, 3, 85)
    assert kept.columns == docs.columns and [r.doc_id for r in kept.collect()] == [1]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame(chain + star + [(5000, 5000), (7, 3)], "a long, b long")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}


def test_match_threshold():
    t = largest_threshold(64, 0.85, 1e-6)
    assert at_most(t - 1, 64, 0.85) <= 1e-6 < at_most(t, 64, 0.85)


def test_query_matches_brute_force(spark):
    docs = connect(SF_DIR).execute("SELECT doc_id, text FROM documents").fetchall()
    expected = brute(docs, 3, 85)
    rows = queries.op1_near_duplicates(spark, SF_DIR).collect()
    assert {r.doc_id: r.component_id for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) and r.n_shingles == len(sets(dict(docs)[r.doc_id], 3)) for r in rows)
