"""Containment search against brute force."""

import random
import re

import pytest

from tests.oracle import compare, connect
from tidemark.llm import decontamination, queries

SF_DIR = "/root/testdata/sf0.001"


def runs(text, span=5):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + span]) for i in range(len(words) - span + 1)}


def brute(docs, items, least_words=1):
    found = set()
    for item, text in items:
        words = re.findall(r"[^\W_]+", (text or "").lower())
        if len(words) < least_words:
            continue
        span = min(5, len(words))
        wanted = runs(text, span) if span else set()
        for doc, body in docs:
            shared = len(wanted & runs(body, span))
            if wanted and shared * 100 >= 80 * len(wanted):
                found.add((doc, item, len(wanted), shared))
    return found


def planted():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([5, 6, 9, 16, 33, 60]))) for i in range(40)] + [(90, text(3)), (91, None), (92, []), (93, text(1)), (94, text(4)), (95, ["w7", "w8"]), (96, ["nowhere"])]
    docs = []
    for i in range(60):
        body = text(rng.choice([10, 400, 3000]))
        for _ in range(rng.randint(0, 3)):
            piece = list(rng.choice(items[:40])[1])
            for _ in range(rng.randint(0, 3)):
                piece[rng.randrange(len(piece))] = "changed"
            at = rng.randrange(len(body))
            body[at:at] = piece
        docs.append((i, (rng.choice([" ", "\n", "*** "])).join(body).replace("w1", "W1")))
    docs += [(100, None), (101, ""), (102, "one two"), (None, " ".join(items[5][1]))]
    return docs, [(i, None if t is None else " ".join(t)) for i, t in items]


def test_planted_items_match_brute_force(spark):
    docs, items = planted()
    found = decontamination.find_items(
        spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, item string"),
        spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, hash string"),
    )
    assert {tuple(r) for r in found.collect()} == brute(docs, items)
    assert len(brute(docs, items)) > 20


def test_filter_keeps_clean_rows_and_columns(spark):
    docs, items = planted()
    table = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, doc int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontamination.without_items(table, bench)
    leaks = {d for d, *_ in brute(docs, items, least_words=5)}
    assert kept.columns == table.columns
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - leaks


def test_short_items_are_found_as_their_words(spark):
    docs = spark.createDataFrame([(1, "Alpha, beta gamma delta"), (2, "alpha gamma"), (3, "delta")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "beta gamma"), (2, "alpha beta gamma delta"), (3, "DELTA"), (4, "gamma beta"), (5, "")], "item_id long, text string")
    assert {tuple(r) for r in decontamination.find_items(docs, items).collect()} == {(1, 1, 1, 1), (1, 2, 1, 1), (1, 3, 1, 1), (3, 3, 1, 1)}
    kept = decontamination.without_items(docs, items, least_words=4)
    assert {r.doc_id for r in kept.collect()} == {2, 3}


def test_most_shingles_of_documents_fall_out_before_the_join(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").selectExpr("doc_id AS doc", "text")
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet").selectExpr("item_id AS item", "text")
    values, spans = decontamination.sketches(items), decontamination.spans_of(items)
    every = docs.select(decontamination.document_shingles(docs.text, decontamination.hashed_run, spans).alias("h"))
    total = sum(len(r.h) for r in every.collect())
    assert 0 < decontamination.kept_hashes(docs, values, spans).count() < 0.2 * total


@pytest.mark.parametrize("rows", [([], [(1, "a b c d e")]), ([(1, "a b c d e")], []), ([], [])])
def test_empty_tables(spark, rows):
    docs = spark.createDataFrame(rows[0], "doc_id long, text string")
    items = spark.createDataFrame(rows[1], "item_id long, text string")
    assert decontamination.find_items(docs, items).count() == 0


def test_query_matches_sql(spark):
    df = queries.op7_decontamination(spark, SF_DIR)
    result = connect(SF_DIR).execute(queries.OP7_SQL)
    columns = [d[0] for d in result.description]
    assert compare([tuple(r) for r in df.collect()], df.columns, result.fetchall(), columns) is None
