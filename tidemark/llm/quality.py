"""Quality rules with cutoffs that a labelled holdout proves safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.binomial import at_most
from tidemark.llm.shared import columns_of, map_rows, without_ids, written

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"
)
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
#: Good documents of a stratum that all rules together may reject, as a share, and the risk that
#: any stratum exceeds it.
FALSE_REJECTIONS = 0.04
RISK = 0.05

#: Rules: the measure in thousandths, above a cutoff is bad; cutoffs from loose to strict.
RULES: dict[str, tuple[str, tuple[int, ...]]] = {
    "symbols": ("1000 * n_symbols / greatest(n_words, 1)", (2000, 1000, 500, 250, 120, 60, 30, 10)),
    "dup_lines": ("1000 * n_dup_lines / greatest(n_lines, 1)", (800, 650, 500, 400, 340, 300, 250, 200, 150, 100)),
    "repeats": ("1000 * n_repeat_words / greatest(n_words, 1)", (900, 700, 500, 400, 300, 250, 200, 150, 100)),
    "word_chars": ("1000 * word_chars / greatest(n_words, 1)", (20000, 14000, 11000, 9500, 8500, 7500, 7000)),
}


def measures(text: str) -> tuple[int, int, int, int, int, int]:
    """Words, code points in them, symbols, lines with a word, repeated ones of these, and words
    in three-word windows that the text holds twice or more."""
    import numpy as np

    words = text.encode().split()
    n = len(words)
    spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    repeated = 0
    if n > 3:
        codes = np.fromiter(map(hash, words), np.int64, n).astype(np.uint64)
        windows = codes[:-2] * np.uint64(0x9E3779B97F4A7C15)
        windows ^= codes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        windows += codes[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            inside = np.zeros(n, bool)
            for shift in range(3):
                inside[shift : n - 2 + shift] |= twice
            repeated = int(inside.sum())
    return n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """``id``, ``stratum``, ``text_key`` (equal for equal texts) and the measures of whole texts; a
    null text has no words, and a null stratum is the stratum ``''``. Repeated rows each give a
    row; other columns are ignored, whatever they are called; an empty table gives none."""

    def rows(tuples):
        import xxhash

        for key, stratum, text in tuples:
            text = text or ""
            yield key, str(stratum or ""), xxhash.xxh3_128_digest(text.encode()), *measures(text)

    kind = dict(docs.dtypes)[id_col]
    return map_rows(
        columns_of(docs, id=id_col, stratum=stratum_col, text=text_col), rows,
        f"id {kind}, stratum string, text_key binary, {MEASURES}",
    )


def strictest(n: int, rejected: list[int], share: float, risk: float) -> int | None:
    """Place of the strictest cutoff whose rejection rate of good documents is below ``share``.

    The upper Clopper-Pearson bound at ``risk`` is below ``share`` exactly if so few rejections
    have a chance of at most ``risk`` at that rate. Cutoffs are tested from loose to strict until
    one fails, which holds the risk of the sequence at that of one test.
    """
    found = None
    for place, k in enumerate(rejected):
        if n == 0 or at_most(k, n, share) > risk:
            break
        found = place
    return found


def value(rule: str) -> Column:
    """A rule's measure; a whole division, so that equal documents fall on the same side."""
    top, _, bottom = RULES[rule][0].partition(" / ")
    return F.expr(f"({top}) div ({bottom})")


def cutoffs(
    measured: DataFrame,
    labels: DataFrame,
    share: float = FALSE_REJECTIONS,
    risk: float = RISK,
    id_col: str = "doc_id",
    label_col: str = "quality",
) -> DataFrame:
    """``stratum`` and a cutoff per rule, null where none is proven; a written table.

    All labelled documents are the holdout, as nothing else is fitted on them; copies of a text are
    one trial, since the bounds ask for independent ones. The share of good
    documents that may be lost is split evenly over the rules, and the risk over rules and strata
    (Bonferroni), so that with probability ``1 - risk`` no stratum loses more than ``share``. A
    document with several labels is good if one of them says so; null labels say nothing. One row
    of counts per stratum is all that is gathered.
    """
    good = (
        columns_of(labels, of=id_col, label=label_col)
        .filter("label IS NOT NULL AND of IS NOT NULL")
        .groupBy("of")
        .agg(F.max("label").alias("label"))
        .filter("label = 1")
    )
    rows = measured.join(good, F.col("id") == F.col("of")).dropDuplicates(["stratum", "text_key"])
    counted = rows.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.array(*[F.sum((value(rule) > c).cast("long")) for c in steps]).alias(rule)
            for rule, (_, steps) in RULES.items()
        ],
    )
    counted = written(counted, "holdout")
    strata = max(1, counted.count())
    each_share, each_risk = share / len(RULES), risk / (len(RULES) * strata)

    def proven(tuples):
        for stratum, n, *rejected in tuples:
            found = [strictest(n, list(k), each_share, each_risk) for k in rejected]
            yield stratum, *[None if at is None else steps[at] for at, (_, steps) in zip(found, RULES.values())]

    schema = "stratum string, " + ", ".join(f"cut_{rule} int" for rule in RULES)
    return written(map_rows(counted, proven, schema), "cutoffs")


def judged(measured: DataFrame, proven: DataFrame) -> DataFrame:
    """The measures with ``base_failed``, ``rejected_by`` (names of rules) and ``kept``.

    The table of cutoffs has a row per stratum; Spark broadcasts it where its written size allows.
    A stratum without labelled documents has no cutoffs, so no rule rejects there.
    """
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.filter(
        F.array(*[F.when(value(rule) > F.col(f"cut_{rule}"), rule) for rule in RULES]), lambda r: r.isNotNull()
    )
    return (
        measured.join(proven, "stratum", "left")
        .withColumn("base_failed", base)
        .withColumn("rejected_by", broken)
        .withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
        .drop("text_key", *[f"cut_{rule}" for rule in RULES])
    )


def judge(docs: DataFrame, labels: DataFrame, share: float = FALSE_REJECTIONS, risk: float = RISK) -> DataFrame:
    """Measures and verdict of every document; the measures are made once and written.

    An empty table gives no rows; repeated rows each get a verdict.
    """
    measured = written(measure(docs), "measures")
    return judged(measured, cutoffs(measured, labels, share, risk))


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``docs`` without those that are rejected; all columns as they were, whatever they are
    called. Rows that share an id go together, if one of them is rejected."""
    rejected = judge(docs, labels).filter(~F.col("kept")).select("id").distinct()
    return without_ids(docs, id_col, written(rejected, "rejected"))
