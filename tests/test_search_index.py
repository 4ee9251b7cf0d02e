"""The blocked index gives what a scan of all records gives, and looks at few of them."""

import datetime as dt
import random

import pytest

from tidemark.operators import search

UNIVERSE = ["IONQ", "RGTI"]


def corpus(seed, records=400, queries=25):
    rng = random.Random(seed)
    common = ["the", "of", "and", "ionq", "is"]
    rare = [f"w{i}" for i in range(150)]
    text = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(rare) for _ in range(n))
    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(30)), i, text(rng.choice([0, 3, 20, 80]))) for i in range(records)]
    asked = [(q, text(rng.choice([1, 6, 20]))) for q in range(queries)]
    return rows, asked + [(100, "the of and"), (101, ""), (102, "unknown words"), (103, "ionq"), (104, "w3")]


def scan(rows, asked, k):
    out = set()
    for q, text in asked:
        wanted = set(text.lower().split())
        scored = []
        for record, at, seq, body in rows:
            both = wanted & set(body.lower().split())
            score = len(both) + 3 * len(both & {u.lower() for u in UNIVERSE})
            if score:
                scored.append((-score, -at.toordinal(), seq, record))
        out |= {(q, record, -score, i) for i, (score, _, _, record) in enumerate(sorted(scored)[:k], 1)}
    return out


@pytest.mark.parametrize("k,common,lead,block", [(5, 0.05, 1000, 4096), (3, 0.3, 10, 16), (1, 0.0, 1, 4096), (50, 1.0, 1000, 64)])
def test_equals_a_scan(spark, monkeypatch, k, common, lead, block):
    monkeypatch.setattr(search, "LEAD_RECORDS", lead)
    monkeypatch.setattr(search, "BLOCK_RECORDS", block)
    rows, asked = corpus(k)
    records = spark.createDataFrame(rows, "record_id long, observed_at date, seq long, text string")
    queries = spark.createDataFrame(asked, "query_id long, text string")
    hits = search.lexical_search(queries, records, UNIVERSE, k, records["text"], common)
    assert {tuple(r) for r in hits.collect()} == scan(rows, asked, k)


def test_common_tokens_are_not_joined_and_few_records_are_scored(spark, monkeypatch):
    sf_dir = "/root/testdata/sf0.1"
    from tidemark.plans.lexical import UNIVERSE as WORDS
    from tidemark.plans.lexical import search_inputs

    read, scored = [], []
    blocks, scores = search.read_blocks, search.full_scores
    monkeypatch.setattr(search, "read_blocks", lambda terms, index: (read.append(terms), blocks(terms, index))[1])
    monkeypatch.setattr(search, "full_scores", lambda pairs, *rest: (scored.append(pairs), scores(pairs, *rest))[1])
    queries, records = search_inputs(spark, sf_dir)
    search.lexical_search(queries, records, WORDS, text=records["text"]).collect()
    assert len(read) == 2 and not any(t.filter("common").count() for t in read)
    assert scored[-1].count() < 0.01 * queries.count() * records.count()
