"""Semantic memory: facts with a time to live, access counts, forgetting and contradiction.

Every function takes the present moment as ``as_of``; none reads the clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import by_level, direction, signed
from tidemark.operators.topk import top_k

FACT_FIELDS = [
    "id", "ticker", "fact_type", "content", "source", "confidence", "created_at", "updated_at",
    "expires_at", "access_count", "last_accessed",
]


def days(n: Column | int) -> Column:
    return F.make_dt_interval(days=n if isinstance(n, Column) else F.lit(n))


def new_facts(rows: DataFrame, as_of: Column, ttl_days: Column | int = 90) -> DataFrame:
    """Fact rows (``ticker, fact_type, content, source, confidence``, ``id``) as stored."""
    confidence = F.col("confidence") if "confidence" in rows.columns else F.lit(1.0)
    return rows.select(
        "id", "ticker", "fact_type", "content", "source", confidence.alias("confidence"),
        as_of.alias("created_at"), as_of.alias("updated_at"), (as_of + days(ttl_days)).alias("expires_at"),
        F.lit(0).cast("long").alias("access_count"),
        F.lit(None).cast(dict(rows.select(as_of.alias("t")).dtypes)["t"]).alias("last_accessed"),
    )


def live_facts(facts: DataFrame, as_of: Column, ticker: str | None = None, fact_type: str | None = None) -> DataFrame:
    out = facts.filter(F.col("expires_at") > as_of)
    if ticker is not None:
        out = out.filter(F.col("ticker") == ticker)
    if fact_type is not None:
        out = out.filter(F.col("fact_type") == fact_type)
    return out


def latest_facts(facts: DataFrame, as_of: Column, k: int, keys: list[str] = ["ticker"]) -> DataFrame:
    """The ``k`` most recently updated live facts per group, more used ones first on a tie."""
    order = [F.desc("updated_at"), F.desc("access_count"), F.asc("id")]
    return top_k(live_facts(facts, as_of), keys, order, k)


def first_facts(facts: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """The overall latest live facts, with the fields a knowledge listing shows."""
    return (
        live_facts(facts, as_of)
        .orderBy(F.desc("updated_at"), F.desc("access_count"), F.asc("id"))
        .limit(limit)
        .select("id", "ticker", "fact_type", "content", "source", "confidence", "created_at")
    )


def with_fate(facts: DataFrame, as_of: Column, idle_days: int = 30) -> DataFrame:
    """``fate`` of each fact in a forgetting cycle: expired first, then pruned if never used and
    older than ``idle_days``, else kept. A fact expiring at this very moment is kept."""
    idle = (F.col("access_count") == 0) & (F.col("created_at") < as_of - days(idle_days))
    return facts.withColumn(
        "fate", F.when(F.col("expires_at") < as_of, "expired").when(idle, "pruned").otherwise("kept")
    )


def survivors(facts: DataFrame, as_of: Column) -> DataFrame:
    return with_fate(facts, as_of).filter("fate = 'kept'").drop("fate")


def forgetting_counts(facts: DataFrame, as_of: Column, signals: DataFrame | None = None, age_days: int = 60) -> DataFrame:
    """What a forgetting cycle expires, prunes and keeps, and, given the stored signals, how many
    of them are old enough to be consolidated."""
    counts = with_fate(facts, as_of).agg(
        F.count_if(F.col("fate") == "expired").alias("expired"),
        F.count_if(F.col("fate") == "pruned").alias("pruned"),
        F.count_if(F.col("fate") == "kept").alias("kept"),
    )
    if signals is None:
        return counts
    return counts.withColumn("consolidated", consolidated_ids(signals, as_of, age_days).agg(F.count("*")).scalar())


def accesses(found: DataFrame, as_of: Column) -> DataFrame:
    """The access rows that reading ``found`` leaves, to be appended to the log."""
    return found.select(F.col("id").alias("fact_id"), as_of.alias("at"))


def with_accesses(facts: DataFrame, accesses: DataFrame) -> DataFrame:
    """Apply an append-only access log (``fact_id, at``) to the counts.

    The log is summed per fact before the join, so a fact read very often is one row by then.
    """
    log = accesses.groupBy("fact_id").agg(F.count("*").alias("_reads"), F.max("at").alias("_last"))
    return (
        facts.join(log.withColumnRenamed("fact_id", "id"), "id", "left")
        .withColumns(
            {
                "access_count": F.col("access_count") + F.coalesce("_reads", F.lit(0)),
                "last_accessed": F.coalesce(F.greatest("_last", "last_accessed"), "_last", "last_accessed"),
            }
        )
        .drop("_reads", "_last")
    )


def never_contradicts(old: Column, new: Column) -> Column:
    return F.lit(False)


def apply_contradictions(
    facts: DataFrame,
    updates: DataFrame,
    as_of: Column,
    contradicts: Callable[[Column, Column], Column] = never_contradicts,
    latest: int = 5,
) -> DataFrame:
    """Halve the confidence of contradicted facts and add the new ones.

    ``updates`` has one new fact per ticker (``id, ticker, content, source``). Only the latest
    live facts of the ticker are compared; ``contradicts`` decides from the old and new text.
    """
    candidates = latest_facts(facts, as_of, latest).select("id", "ticker", F.col("content").alias("_old"))
    hit = (
        candidates.join(updates.select("ticker", F.col("content").alias("_new")), "ticker")
        .filter(contradicts(F.col("_old"), F.col("_new")))
        .select("id")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    weakened = (
        facts.join(hit, "id", "left")
        .withColumns(
            {
                "confidence": F.when(F.col("_hit"), F.col("confidence") * 0.5).otherwise(F.col("confidence")),
                "updated_at": F.when(F.col("_hit"), as_of).otherwise(F.col("updated_at")),
            }
        )
        .drop("_hit")
    )
    added = updates.select(
        "id", "ticker", F.lit("updated_fact").alias("fact_type"), "content", "source", F.lit(1.0).alias("confidence")
    )
    return weakened.select(*FACT_FIELDS).unionByName(new_facts(added, as_of).select(*FACT_FIELDS))


def weekly_summaries(signals: DataFrame, as_of: Column, age_days: int = 60, least: int = 10) -> DataFrame:
    """Counts per week of signals older than ``age_days``; nothing when there are fewer than
    ``least`` of them.

    The stored form of the consolidation is left open upstream; this is the plain weekly count
    with the range of ids. :func:`consolidated_ids` lists the members.
    """
    old = signals.filter(F.col("article_date") < F.date_sub(as_of, age_days))
    weeks = old.groupBy(F.trunc("article_date", "week").alias("week")).agg(
        F.count("*").alias("signals"),
        F.count_if(F.col("score") > 0).alias("bullish"),
        F.avg("score").alias("mean_score"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )
    return weeks.filter(old.agg(F.count("*") >= least).scalar())


def consolidated_ids(signals: DataFrame, as_of: Column, age_days: int = 60) -> DataFrame:
    """Members of each weekly summary as rows, so a busy week never becomes one long list."""
    old = signals.filter(F.col("article_date") < F.date_sub(as_of, age_days))
    return old.select(F.trunc("article_date", "week").alias("week"), "id")


def cut(text: Column, chars: int | None) -> Column:
    """``text``, or its first ``chars`` characters."""
    return text if chars is None else F.left(text, F.lit(chars))


def signal_headers(predictions: DataFrame, as_of: Column, title_chars: int | None = None) -> DataFrame:
    """Signal history rows from predictions, with their reasoning and model."""
    return predictions.select(
        F.col("article_idx").alias("id"),
        F.col("date").alias("article_date"),
        cut(F.col("title"), title_chars).alias("article_title"),
        F.col("source").alias("article_source"),
        "signal_vector",
        "reasoning",
        "model_used",
        F.lit(None).cast("boolean").alias("was_correct"),
        as_of.alias("created_at"),
    )


def signal_directions(signals: DataFrame) -> DataFrame:
    """Long form of the stored signal: one row per ticker with its three-way direction."""
    return signals.withColumn("predicted_direction", direction(F.coalesce("score", F.lit(0.0))))


def latest_signals(signals: DataFrame, k: int, keys: list[str] = ["ticker"]) -> DataFrame:
    """Most recent signals per ticker, by exact ticker key; of all signals without ``keys``."""
    if not keys:
        return signals.orderBy(F.desc("article_date"), F.asc("id")).limit(k)
    return top_k(signals, keys, [F.desc("article_date"), F.asc("id")], k)


def signal_listing(stored: DataFrame, limit: int) -> DataFrame:
    """The latest stored signals with the six fields a listing shows."""
    return latest_signals(stored, limit, []).select(
        "id", F.col("article_date").alias("date"), F.col("article_title").alias("title"),
        F.col("article_source").alias("source"), F.coalesce("signal_vector", F.lit("{}")).alias("signal_vector"),
        F.col("model_used").alias("model"),
    )


def event_facts(events: DataFrame, content_chars: int | None = None) -> DataFrame:
    """Source events as facts: confidence and time to live follow the significance. Here and in
    the forms below a width is a choice of the caller; without one texts are kept whole."""
    return events.select(
        "id",
        "ticker",
        F.col("source_type").alias("fact_type"),
        F.concat(
            F.lit("["), F.col("date").cast("string"), F.lit("] "), F.col("title"), F.lit(": "),
            cut(F.col("content"), content_chars),
        ).alias("content"),
        F.col("source_type").alias("source"),
        by_level(F.col("significance"), fixed.SIGNIFICANCE_CONFIDENCE).alias("confidence"),
        by_level(F.col("significance"), fixed.SIGNIFICANCE_TTL_DAYS).alias("ttl_days"),
    )


def reasoned_facts(
    signals: DataFrame, min_reasoning: int = 50, min_score: float = 0.3, chars: int | None = None
) -> DataFrame:
    """Server form: article reasoning longer than ``min_reasoning``, |score| above ``min_score``;
    the ticker's own reasoning follows the score."""
    kept = signals.filter((F.length("reasoning") > min_reasoning) & (F.abs("score") > min_score))
    own = cut(F.coalesce("ticker_reasoning", F.lit("")), chars)
    return kept.select(
        "id", "ticker", F.lit("signal_context").alias("fact_type"),
        F.concat(
            F.lit("On "), F.col("date").cast("string"), F.lit(": score="), F.col("score").cast("string"),
            F.lit(" "), own,
        ).alias("content"),
        "source", F.lit(90).alias("ttl_days"),
    )


def ticker_reasoning_facts(
    signals: DataFrame, min_reasoning: int = 20, min_score: float = 0.5, chars: int | None = None
) -> DataFrame:
    """Evaluation form: the ticker's own reasoning, if long enough and the score strong enough."""
    kept = signals.filter(
        (F.length("ticker_reasoning") > min_reasoning) & (F.abs("score") >= min_score)
    )
    return kept.select(
        "id", "ticker", F.lit("signal_context").alias("fact_type"),
        F.concat(
            F.lit("["), F.col("date").cast("string"), F.lit("] "), cut(F.col("ticker_reasoning"), chars)
        ).alias("content"),
        "source", F.lit(60).alias("ttl_days"),
    )


def loop_facts(
    signals: DataFrame, min_reasoning: int = 30, min_score: float = 0.5, chars: int | None = None
) -> DataFrame:
    """Loop form: the score and the article's reasoning."""
    kept = signals.filter((F.length("reasoning") > min_reasoning) & (F.abs("score") >= min_score))
    return kept.select(
        "id", "ticker", F.lit("signal_context").alias("fact_type"),
        F.concat(
            F.lit("["), F.col("date").cast("string"), F.lit("] Score "), signed(F.col("score"), 1), F.lit(": "),
            cut(F.col("reasoning"), chars),
        ).alias("content"),
        "source", F.lit(60).alias("ttl_days"),
    )


def memory_stats(facts: DataFrame, history: DataFrame) -> DataFrame:
    """Counts of facts and signals with the accuracy counts, as one row."""
    from tidemark.operators.episodes import accuracy_counts

    return accuracy_counts(history).select(
        facts.agg(F.count("*")).scalar().alias("knowledge_facts"),
        (F.col("correct") + F.col("incorrect") + F.col("pending")).alias("signals_stored"),
        "correct", "incorrect", "pending", "accuracy",
    )
