"""Toxicity by sparse logistic regression, fitted with FTRL-proximal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import columns_of, map_rows, written

#: Weights live in 2^BITS buckets, which bounds the model.
BITS = 20
#: Labelled rows that are fitted on, at most.
TRAINING_ROWS = 16_384
EPOCHS = 5
FOLDS = 5
#: Learning rate, its smoothing, and the L1 and L2 strengths.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 5.0, 0.1
BIAS = 1 << BITS

#: ASCII characters that are not letters end a word.
ENDS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def features(text: str):
    """Buckets of a text's words, pairs of neighbours, and pairs one word apart, in no order and
    with repeats. Words are runs of letters, lower-case."""
    import numpy as np
    import xxhash

    words = text.lower().encode().translate(ENDS).split()
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    turned = codes * np.uint64(0x9E3779B97F4A7C15)
    near = (turned[:-1] ^ codes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    apart = (turned[:-2] ^ codes[2:]) * np.uint64(0xD6E8FEB86659FD93)
    return (np.concatenate([turned, near, apart]) >> np.uint64(64 - BITS)).astype(np.int32)


def fit_rows(rows: list[tuple], epochs: int = EPOCHS, seed: int = 11):
    """Buckets and weights that are not zero, the bias as bucket ``BIAS``, from (buckets, label).

    Each coordinate has its own rate, which falls with the squares of the gradients it has seen,
    and stays at zero until these outweigh ``L1``. The bias starts at the log odds of the labels.
    """
    import numpy as np

    positives = sum(label for _, label in rows)
    bias = float(np.log((positives + 1) / (len(rows) - positives + 9)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_n = 1.0
    order = np.random.default_rng(seed)

    def weights(at):
        value = z[at]
        over = np.maximum(np.abs(value) - L1, 0.0)
        return -np.sign(value) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, label = rows[k]
            w = weights(at)
            gradient = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - label
            square = gradient * gradient
            root = np.sqrt(n[at])
            z[at] += gradient - (np.sqrt(n[at] + square) - root) / ALPHA * w
            n[at] += square
            bias_n += square
            bias -= 0.1 * gradient / np.sqrt(bias_n)
    every = np.flatnonzero(np.abs(z) > L1)
    return np.append(every, BIAS), np.append(weights(every), bias)


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the fold that is never learnt from; an id of null does not."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    training_rows: int = TRAINING_ROWS,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
) -> DataFrame:
    """The model: ``bucket`` and ``weight``, at most ``2^BITS + 1`` rows, a written table.

    Fitted on at most ``training_rows`` labelled ids outside the held-out fold, the first by a
    hash of the id; their labels are few enough, by that bound, to be broadcast, so texts are
    not shuffled. An id with several labels is toxic if one says so; null labels say nothing.
    """
    labelled = (
        columns_of(labels, of=id_col, label=label_col)
        .filter("of IS NOT NULL AND label IS NOT NULL")
        .filter(~held_out(F.col("of")))
        .groupBy("of")
        .agg(F.max("label").cast("int").alias("label"))
    )
    chosen = written(labelled.orderBy(F.xxhash64(F.lit(7), "of"), "of").limit(training_rows), "training")
    texts = columns_of(docs, id=id_col, text=text_col)
    sample = texts.join(F.broadcast(chosen), F.col("id") == F.col("of")).select("id", "label", "text")

    def featured(tuples):
        import numpy as np

        for key, label, text in tuples:
            yield key, label, np.unique(features(text or "")).tobytes()

    def fitted(tuples):
        import numpy as np

        rows = sorted((key, label, found) for key, label, found in tuples)
        at, weights = fit_rows([(np.frombuffer(found, np.int32), label) for _, label, found in rows])
        yield from zip(at.tolist(), weights.tolist())

    kind = dict(docs.dtypes)[id_col]
    found = written(map_rows(sample, featured, f"id {kind}, label int, found binary"), "features")
    return written(map_rows(found.coalesce(1), fitted, "bucket int, weight double"), "weights")


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of whole texts; a null text counts as empty and has the score
    of the bias alone. The weights that are not zero go to every task."""
    import numpy as np

    weights = model.collect()  # at most 2^BITS + 1 rows
    at = np.array([r.bucket for r in weights], np.int64)
    values = np.array([r.weight for r in weights], np.float64)

    def rows(tuples):
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = values
        used = dense != 0
        for key, text in tuples:
            found = features(text or "")
            found = np.unique(found[used[found]])
            total = dense[BIAS] + dense[found].sum()
            yield key, float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    kind = dict(docs.dtypes)[id_col]
    return map_rows(columns_of(docs, id=id_col, text=text_col), rows, f"id {kind}, score double")
