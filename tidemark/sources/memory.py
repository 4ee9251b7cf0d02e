"""The lexical memory: append-only records with content ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import content_id, strip, ticker_tags, tokens

RECORD_SCHEMA = (
    "record_id string, observed_at string, source string, title string, url string, "
    "tags array<string>, text string, metadata string"
)
FIELDS = ["record_id", "observed_at", "source", "title", "url", "tags", "text", "metadata"]


def read_memory(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Stored records with defaults for missing fields; a missing id is computed."""
    raw = spark.read.schema(RECORD_SCHEMA).json(path)
    filled = raw.select(
        "record_id",
        F.coalesce(F.nullif("observed_at", F.lit("")), F.lit(as_of)).alias("observed_at"),
        F.coalesce("source", F.lit("manual_note")).alias("source"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("metadata", F.lit("{}")).alias("metadata"),
    )
    computed = content_id(F.col("source"), F.col("title"), F.col("observed_at"), F.col("text"))
    return filled.withColumn("record_id", F.coalesce(F.nullif("record_id", F.lit("")), computed))


def to_records(notes: DataFrame, universe: list[str], as_of: str | None = None) -> DataFrame:
    """Notes (text, source, title, url, observed_at, metadata, optional tags) as records.

    Text fields are stripped, tags are inferred from the text when none are given, and the id is
    computed from the content. ``as_of`` stands in for a missing observation time.
    """
    given = F.col("tags") if "tags" in notes.columns else F.array().cast("array<string>")
    inferred = ticker_tags(tokens(F.col("text")), universe)
    observed = F.col("observed_at") if as_of is None else F.coalesce("observed_at", F.lit(as_of))
    shaped = notes.select(
        observed.alias("observed_at"),
        "source",
        strip(F.col("title")).alias("title"),
        strip(F.col("url")).alias("url"),
        F.when(F.coalesce(F.size(given), F.lit(0)) > 0, given).otherwise(inferred).alias("tags"),
        strip(F.col("text")).alias("text"),
        "metadata",
        *(["seq"] if "seq" in notes.columns else []),
    )
    identity = content_id(F.col("source"), F.col("title"), F.col("observed_at"), F.col("text"))
    return shaped.withColumn("record_id", identity)


def first_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The first row of each key in the given order, which must tell the rows of a key apart.

    First places are found on key and order alone, combined on the map side, so a key with very
    many copies shuffles one narrow row per task; the rows themselves are fetched by their place.
    """
    # As one struct, null keys are equal too.
    placed = df.withColumn("_place", F.struct(F.col(key), order.alias("order")))
    first = placed.groupBy(key).agg(F.min("_place").alias("_place"))
    return placed.join(first.select("_place"), "_place", "left_semi").drop("_place")


def new_records(records: DataFrame, store: DataFrame) -> DataFrame:
    """Records to append: the first of each id in ``seq`` order whose id is not stored yet."""
    fresh = first_by(records, "record_id", F.col("seq"))
    return fresh.join(store.select("record_id"), "record_id", "left_anti")


def add_records(records: DataFrame, store: DataFrame) -> DataFrame:
    """The store after adding: existing rows win over new rows with the same id."""
    return store.select(*FIELDS).unionByName(new_records(records, store).select(*FIELDS))


def memory_updates(parsed: DataFrame, analysis: str = "analysis") -> DataFrame:
    """Each non-blank text in the ``memory_updates`` list of an analysis as a note."""
    updates = F.try_variant_get(analysis, "$.memory_updates", "array<variant>")
    text = F.when(
        F.schema_of_variant("_update") == "STRING", F.try_variant_get("_update", "$", "string")
    )
    return (
        parsed.withColumn("_update", F.explode(updates))
        .select(
            text.alias("text"),
            F.lit("agent_memory_update").alias("source"),
            F.coalesce(F.try_variant_get(analysis, "$.event_type", "string"), F.lit("")).alias("title"),
            F.lit("").alias("url"),
            "observed_at",
            F.to_json(F.struct(F.col("source").alias("derived_from_source"))).alias("metadata"),
        )
        .filter("text IS NOT NULL")
        .filter(strip(F.col("text")) != "")
    )
