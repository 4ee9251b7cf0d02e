"""From raw documents to token ids: rules, near duplicates, test items, personal data, pieces.

In every stage a null text is an empty one, texts are taken whole, further columns stay as they
are, whatever they are called, and an empty table gives an empty one. Rows that share an id are
dropped together; null ids are one id for the rules and the test items, and are never duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, near_duplicates, personal_data, quality, sentence_pieces
from tidemark.llm.queries import table, tokenizer_file
from tidemark.llm.shared import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or a proven cutoff reject; without labels no cutoff is proven."""
    return quality.without_rejected(docs, table(spark, sf_dir, "labels"))


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each group of texts that share four fifths of their five-word runs; all
    rows of that id stay."""
    return near_duplicates.without_duplicates(docs, words=5, similarity=80)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a test item of at least five words."""
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def personal_data_marks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text."""
    clean = personal_data.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    n_chars = F.length("text").cast(dict(docs.dtypes)["n_chars"])
    return clean.withColumn("n_chars", n_chars)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the whole texts, and whether they decode to the texts again; a row per row."""
    coded = sentence_pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))
    return coded.select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicate_groups),
    ("decontamination", benchmark_items),
    ("personal_data", personal_data_marks),
    ("sentence_pieces", pieces),
]

#: SQL has neither exact bounds nor the piece encoding; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
