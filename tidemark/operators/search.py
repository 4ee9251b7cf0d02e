"""Lexical search: exact top-k by shared tokens, from an inverted index in blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import tokens
from tidemark.operators.topk import top_k
from tidemark.session import materialise

TICKER_BONUS = 3
COMMON_SHARE = 0.05
#: Records of one index block if a token is in all of them.
BLOCK_RECORDS = 4096
#: Records of a query's rarest tokens that are looked at, and those scored, to find its floor.
LEAD_RECORDS = 1000
LEADERS = 20


def record_text() -> Column:
    """What a search looks at: title, text and tags."""
    return F.concat_ws(" ", F.col("title"), F.col("text"), F.array_join("tags", " "))


def query_terms(queries: DataFrame, universe: list[str]) -> DataFrame:
    """``query_id, token, weight``: 1 per shared token, more for a ticker."""
    tickers = [t.lower() for t in universe]
    weight = F.when(F.col("token").isin(tickers), 1 + TICKER_BONUS).otherwise(1)
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("token")).withColumn(
        "weight", weight.cast("long")
    )


def record_terms(records: DataFrame, text: Column) -> DataFrame:
    return records.select("record_id", F.explode(tokens(text)).alias("token"))


def record_bags(records: DataFrame, text: Column, vocabulary: DataFrame) -> DataFrame:
    """``record_id``, ``bag`` (its tokens that a query asks for) and ``mass`` (what they weigh)."""
    held = record_terms(records, text).join(vocabulary, "token")
    return held.groupBy("record_id").agg(F.collect_list("token").alias("bag"), F.sum("weight").alias("mass"))


def blocked_index(bags: DataFrame, records: int) -> DataFrame:
    """The inverted index: ``token``, ``entries`` (records and their mass), ``n`` of them and their
    ``largest`` mass.

    A token's records are cut into blocks by the size of their mass, and beyond ``BLOCK_RECORDS``
    by a hash of the record, so a block of a token that every record holds stays small. No record
    of a block can score more than the block's largest mass.
    """
    parts = max(1, math.ceil(records / BLOCK_RECORDS))
    entry = F.struct("record_id", "mass")
    return (
        bags.select(F.explode("bag").alias("token"), "record_id", "mass")
        .groupBy("token", F.floor(2 * F.log2("mass")).alias("band"), F.pmod(F.xxhash64("record_id"), F.lit(parts)).alias("part"))
        .agg(F.collect_list(entry).alias("entries"), F.max("mass").alias("largest"), F.count(F.lit(1)).alias("n"))
        .select("token", "entries", "largest", "n")
    )


def read_blocks(terms: DataFrame, index: DataFrame) -> DataFrame:
    """``query_id, record_id, part, mass`` of the records in the blocks of the query terms; ``part``
    is what these terms add. A term with a ``floor`` skips blocks, and records, that cannot reach it."""
    found = terms.join(index, "token").filter("largest >= floor")
    each = found.select("query_id", "weight", "floor", F.explode("entries").alias("entry")).filter("entry.mass >= floor")
    return each.groupBy("query_id", F.col("entry.record_id").alias("record_id")).agg(
        F.sum("weight").alias("part"), F.first("entry.mass").alias("mass")
    )


def full_scores(pairs: DataFrame, asked: DataFrame, bags: DataFrame, tickers: list[str]) -> DataFrame:
    """``query_id, record_id, score`` over all tokens of both."""
    both = F.array_intersect("bag", "asked")
    named = F.array_intersect(both, F.array(*[F.lit(x) for x in tickers]).cast("array<string>"))
    score = (F.size(both) + TICKER_BONUS * F.size(named)).cast("long")
    return pairs.join(bags, "record_id").join(asked, "query_id").select("query_id", "record_id", score.alias("score"))


def lexical_search(
    queries: DataFrame,
    records: DataFrame,
    universe: list[str],
    k: int = 5,
    text: Column | None = None,
    common_share: float = COMMON_SHARE,
) -> DataFrame:
    """``query_id, record_id, score, pos``: the ``k`` best records of each query.

    The score is the number of shared tokens plus three per shared ticker; ties go to the later
    observation, then to the lower ``seq``. ``queries`` has ``query_id, text``; ``records`` has
    ``record_id, observed_at, seq`` and the text. A query without tokens that a record holds has
    no hits.

    An inverted index in blocks is read rarest token first. The few records that share most of a
    query's rarest tokens are scored in full; the k-th of these scores is a floor that every hit
    must reach. Reading then stops at the tokens that cannot reach the floor together: those in
    more than ``common_share`` of the records are read only where they could. Of the records read,
    those whose part, with all that is unread, reaches the floor are scored in full. Floors only
    ever leave out what cannot win, so the result is that of a scan.
    """
    tickers = sorted({t.lower() for t in universe})
    wanted = materialise(query_terms(queries, universe), "query-terms")
    vocabulary = wanted.groupBy("token").agg(F.first("weight").alias("weight"))
    total = records.count()
    bags = materialise(record_bags(records, record_text() if text is None else text, vocabulary), "bags")
    index = materialise(blocked_index(bags, total), "index")
    frequency = index.groupBy("token").agg(F.sum("n").alias("records"))
    # A query's own terms; ``upto`` is the weight of this and all more frequent ones.
    by_rank = Window.partitionBy("query_id").orderBy
    terms = materialise(
        wanted.join(frequency, "token")
        .withColumn("common", F.col("records") > total * common_share)
        .withColumn("upto", F.sum("weight").over(by_rank(F.desc("records"), "token")))
        .withColumn("read", F.sum("records").over(by_rank("records", F.desc("token"))) - F.col("records")),
        "weighted-terms",
    )
    asked = terms.groupBy("query_id").agg(F.collect_list("token").alias("asked"))
    rarest = terms.filter(f"read = 0 OR NOT common AND read + records <= {LEAD_RECORDS}")
    leaders = top_k(
        read_blocks(rarest.withColumn("floor", F.lit(0)), index),
        ["query_id"], [F.desc("part"), F.desc("mass"), F.asc("record_id")], LEADERS,
    )
    first = full_scores(leaders.select("query_id", "record_id"), asked, bags, tickers)
    floors = top_k(first, ["query_id"], [F.desc("score"), F.asc("record_id")], k).groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min("score")).otherwise(0).alias("floor")
    )
    bounded = materialise(terms.join(floors, "query_id"), "bounded-terms")
    unread = "common AND upto < floor"
    left = bounded.groupBy("query_id", "floor").agg(F.sum(F.expr(f"IF({unread}, weight, 0)")).alias("unread"))
    proposed = read_blocks(bounded.filter(f"NOT ({unread})"), index).join(left, "query_id")
    contenders = proposed.filter("part + least(unread, mass - part) >= floor").select("query_id", "record_id")
    scored = full_scores(materialise(contenders, "contenders"), asked, bags, tickers)
    identity = records.select("record_id", "observed_at", "seq")
    order = [F.desc("score"), F.desc("observed_at"), F.asc("seq")]
    best = top_k(scored.join(identity, "record_id"), ["query_id"], order, k)
    return best.select("query_id", "record_id", "score", "pos")
