"""The fitted model finds held-out toxic texts and leaves clean ones alone."""

import random
import zlib

from tidemark.llm import queries, toxicity

SF_DIR = "/root/testdata/sf0.001"


def made(spark, n=1500, noise=()):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioutrnsl") for _ in range(4))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(5, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot***", "Scum,", "moron"]))
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + list(noise), "doc_id long, text string, label string")
    return docs, spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int"), dict(labels)


def test_held_out_rows(spark):
    docs, labels, truth = made(spark, noise=[(9000, None, "x"), (9001, "", "x"), (9002, "y " * 50_000, "x"), (None, "z", "x")])
    model = toxicity.fit(docs, labels)
    weights = model.collect()
    assert 1 < len(weights) < 3000 and sum(r.bucket == toxicity.BIAS for r in weights) == 1
    scores = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    assert len(scores) == 1504 and all(0 <= s <= 1 for s in scores.values())
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((scores[i] >= 0.5) != truth[i] for i in held) <= 0.01 * len(held)
    assert scores[9000] == scores[9001] < 0.5


def test_held_out_labels_are_never_read(spark):
    docs, labels, _ = made(spark, 600)
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(labels["doc_id"]), 1 - labels["toxic"]).otherwise(labels["toxic"]))
    a, b = (sorted(map(tuple, toxicity.fit(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_training_bound_and_no_labels(spark):
    docs, labels, _ = made(spark, 600)
    few = toxicity.fit(docs, labels, training_rows=10)
    assert few.count() >= 1
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.5 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_query(spark):
    rows = queries.op2_toxicity(spark, SF_DIR).collect()
    assert len(rows) == 200
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1


def test_weights_equal_ftrl_by_hand():
    """Every update recomputed with plain numbers, one coordinate at a time."""
    import math

    import numpy as np

    rng = random.Random(12)
    rows = []
    for _ in range(60):
        label = rng.randrange(2)
        at = sorted({rng.randrange(40) + (100 if label and rng.random() < 0.9 else 0) for _ in range(rng.randint(1, 12))})
        rows.append((np.array(at, np.int32), label))
    for epochs in (1, 4):
        z, n, ones = {}, {}, sum(label for _, label in rows)
        bias, bias_n = math.log((ones + 1) / (len(rows) - ones + 9)), 1.0
        weight = lambda i: 0.0 if abs(z.get(i, 0.0)) <= toxicity.L1 else -math.copysign(abs(z[i]) - toxicity.L1, z[i]) / (
            (toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA + toxicity.L2
        )
        order = np.random.default_rng(11)
        for _ in range(epochs):
            for k in order.permutation(len(rows)).tolist():
                at, label = rows[k]
                w = {i: weight(i) for i in at.tolist()}
                gradient = 1 / (1 + math.exp(-(bias + sum(w.values())))) - label
                for i, value in w.items():
                    before = n.get(i, 0.0)
                    rate = (math.sqrt(before + gradient**2) - math.sqrt(before)) / toxicity.ALPHA
                    z[i] = z.get(i, 0.0) + gradient - rate * value
                    n[i] = before + gradient**2
                bias_n += gradient**2
                bias -= 0.1 * gradient / math.sqrt(bias_n)
        expected = {i: weight(i) for i in z if weight(i)} | {toxicity.BIAS: bias}
        at, weights = toxicity.fit_rows(rows, epochs)
        got = dict(zip(at.tolist(), weights.tolist()))
        assert got.keys() == expected.keys() and (epochs == 1 or len(got) > 1)
        assert all(abs(got[i] - expected[i]) < 1e-9 for i in got)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "some words", 0, {"a": 1})], "doc_id long, text string, score int, weight map<string,int>")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs.limit(0), labels)
    assert [r.bucket for r in model.collect()] == [toxicity.BIAS]
    assert toxicity.score(docs, model).columns == ["id", "score"]
    assert toxicity.score(docs.limit(0), model).collect() == []
    assert toxicity.fit(docs, labels.limit(0)).count() == 1
