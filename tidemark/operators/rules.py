"""Behavioural rules learned from accuracy, their storage and the walk-forward reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import whole_percent
from tidemark.operators.episodes import category_counts
from tidemark.operators.prefix import running_totals
from tidemark.operators.topk import joined_text, ordered_text, top_k


def _filled(template: Column) -> Column:
    """The template with the row's key, percentage and count in place."""
    for name, value in (
        ("{key}", F.col("key")),
        ("{pct}", whole_percent(F.col("accuracy"))),
        ("{n}", F.col("total").cast("string")),
    ):
        template = F.replace(template, F.lit(name), value)
    return template


def _chosen(values: list) -> Column:
    """The value that belongs to the row's rule number."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_rule"))


def rules_from_counts(counts: DataFrame, keep: list[str] = []) -> DataFrame:
    """Rules that hold for category counts (``family, key, correct, total``).

    At most one rule per row: the strong bound is tried before the weak one. The rule is first
    settled as a number, then its fields are looked up and filled once.
    """
    accuracy = F.col("accuracy")
    overall = len(fixed.RULE_FAMILIES) + 1
    rule = F.when(
        (F.col("family") == "overall") & (F.col("total") >= fixed.OVERALL_RULE_MIN), F.lit(overall)
    )
    families, fires, bounds, least, rule_ids, caps, categories, texts = zip(*fixed.RULE_FAMILIES)
    for number, (family, kind, bound, needed) in enumerate(zip(families, fires, bounds, least), start=1):
        of_direction = family in ("bullish", "bearish")
        applies = F.col("family") == ("direction" if of_direction else family)
        if of_direction:
            applies = applies & (F.col("key") == family)
        held = accuracy >= bound if kind == "at_least" else accuracy <= bound
        rule = rule.when(applies & (F.col("total") >= needed) & held, F.lit(number))
    low, high, calibrated = fixed.OVERALL_WELL_CALIBRATED
    below, overconfident = fixed.OVERALL_OVERCONFIDENT
    verdict = (
        F.when(accuracy.between(low, high), calibrated)
        .when(accuracy < below, overconfident)
        .otherwise(fixed.OVERALL_STRONG)
    )
    is_overall = F.col("_rule") == overall
    strength = F.when(_chosen([k == "at_least" for k in fires] + [True]), accuracy).otherwise(1 - accuracy)
    return (
        counts.withColumn("accuracy", F.try_divide("correct", "total"))
        .withColumn("_rule", rule)
        .filter("_rule IS NOT NULL")
        .select(
            *keep,
            _filled(_chosen([*rule_ids, fixed.OVERALL_RULE_ID])).alias("rule_id"),
            F.replace(_filled(_chosen([*texts, fixed.OVERALL_RULE_TEXT])), F.lit("{verdict}"), verdict).alias("rule_text"),
            F.when(is_overall, fixed.OVERALL_RULE_CONFIDENCE)
            .otherwise(F.least(strength, _chosen([*caps, 1.0])))
            .alias("confidence"),
            F.col("total").alias("evidence_count"),
            _chosen([*categories, fixed.OVERALL_RULE_CATEGORY]).alias("category"),
        )
    )


def generate_rules(episodes: DataFrame, as_of: Column, keys: list[str] = []) -> DataFrame:
    """Rules from all resolved episodes, stamped ``as_of``."""
    return rules_from_counts(category_counts(episodes, keys), keys).withColumns(
        {"created_at": as_of, "last_validated": as_of}
    )


def upsert_rules(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge by ``rule_id``: a stored rule takes the new text, confidence, evidence and
    validation time and keeps its creation time and category. Nothing is withdrawn."""
    old, fresh = stored.alias("old"), new.alias("new")
    newer = lambda c: F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c)
    older = lambda c: F.coalesce(F.col(f"old.{c}"), F.col(f"new.{c}")).alias(c)
    return old.join(fresh, F.col("old.rule_id") == F.col("new.rule_id"), "full_outer").select(
        older("rule_id"), newer("rule_text"), newer("confidence"), newer("evidence_count"),
        older("created_at"), newer("last_validated"), older("category"),
    )


def active_rules(rules: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    return rules.filter(F.col("confidence") >= min_confidence).orderBy(F.desc("confidence"), "rule_id")


def confidence_label(confidence: Column) -> Column:
    out = F.lit(fixed.RULE_CONFIDENCE_LOW)
    for bound, label in reversed(fixed.RULE_CONFIDENCE_LABELS):
        out = F.when(confidence >= bound, label).otherwise(out)
    return out


def rule_lines(rules: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Printed lines of the active rules with the columns that order them."""
    line = F.concat(
        F.lit("  ["), confidence_label(F.col("confidence")), F.lit(" confidence, "),
        F.col("evidence_count").cast("string"), F.lit(" observations] "), F.col("rule_text"),
    )
    return rules.filter(F.col("confidence") >= min_confidence).withColumn("line", line)


def rules_text(
    rules: DataFrame, keys: list[str] = [], min_confidence: float = 0.5, most_lines: int | None = None
) -> DataFrame:
    """Header and rule lines as one text per group, best first; any number of rules.

    A caller with a character budget passes the number of lines that could fit at all, so that no
    more are gathered; without one the lines are joined level by level.
    """
    lines = rule_lines(rules, min_confidence)
    header = F.lit(fixed.RULES_HEADER + "\n")
    if most_lines is None:
        ranked = lines.withColumn("_rank", -F.col("confidence"))
        texts = ordered_text(ranked, keys, ["_rank", "rule_id"], "line", "\n", name="rule-lines")
        return texts.select(*keys, F.concat(header, "line").alias("rules_text"))
    order = [F.desc("confidence"), F.asc("rule_id")]
    ranked = top_k(lines.withColumn("_all", F.lit(1)), keys or ["_all"], order, most_lines)
    text = F.concat(header, joined_text("pos", "line", "\n")).alias("rules_text")
    return ranked.groupBy(*keys).agg(text)


def rules_from_responses(responses: DataFrame, as_of: Column, keep: list[str] = ["batch"]) -> DataFrame:
    """Rules written by a model: the list between the first ``[`` and the last ``]``.

    Missing fields get defaults; default ids carry the batch so that they never collide.
    """
    span = F.nullif(F.regexp_extract("response", r"(?s)\[.*\]", 0), F.lit(""))
    schema = "array<struct<rule_id string, rule_text string, confidence double, category string>>"
    rows = responses.select(*keep, "evidence_count", F.posexplode(F.from_json(span, schema)).alias("pos", "r"))
    default_id = F.concat_ws("_", F.lit("model_rule"), *[F.col(k).cast("string") for k in keep], F.col("pos"))
    return rows.select(
        *keep,
        F.coalesce("r.rule_id", default_id).alias("rule_id"),
        F.coalesce("r.rule_text", F.lit("")).alias("rule_text"),
        F.coalesce("r.confidence", F.lit(fixed.MODEL_RULE_DEFAULTS["confidence"])).alias("confidence"),
        "evidence_count",
        F.coalesce("r.category", F.lit(fixed.MODEL_RULE_DEFAULTS["category"])).alias("category"),
        as_of.alias("created_at"),
        as_of.alias("last_validated"),
    )


def batch_of(article_idx: Column, size: int = fixed.BATCH_SIZE) -> Column:
    return F.call_function("div", article_idx, F.lit(size)).cast("long")


def rule_history(episodes: DataFrame, keys: list[str]) -> DataFrame:
    """Rule versions: the rules that hold at the end of each batch, for use from the next one.

    ``episodes`` carries ``batch``. Per category only the batches that bring new episodes can
    change a rule, so there is one candidate row per (category, batch with episodes) and the
    counts up to it are a running total; batches are never crossed with categories. Narrow rows
    are brought together by batch, so that what a task counts are a batch's few categories.
    """
    narrow = episodes.select(*keys, "batch", "ticker", "source", "predicted_direction", "was_correct")
    per_batch = category_counts(narrow.repartition(*keys, "batch"), [*keys, "batch"], together=True)
    running = running_totals(per_batch, [*keys, "family", "key"], ["batch"], ["correct", "total"], "rule-history")
    upto = running.select(
        *keys, "batch", "family", "key",
        (F.col("correct_before") + F.col("correct")).alias("correct"),
        (F.col("total_before") + F.col("total")).alias("total"),
    )
    return rules_from_counts(upto, [*keys, "batch"]).withColumn("usable_from", F.col("batch") + 1)


def batch_progress(episodes: DataFrame, batches: DataFrame, history: DataFrame, keys: list[str]) -> DataFrame:
    """Cumulative episodes, accuracy, facts and stored rules after each batch.

    ``batches`` has one row per (keys, batch) with ``articles`` and ``facts``; a rule counts from
    the batch it first held in, since stored rules stay.
    """
    outcomes = resolved_per_batch(episodes, keys)
    first_held = history.groupBy(*keys, "rule_id").agg(F.min("batch").alias("batch"))
    new_rules = first_held.groupBy(*keys, "batch").agg(F.count("*").alias("rules"))
    sizes = batches.join(outcomes, [*keys, "batch"], "left").join(new_rules, [*keys, "batch"], "left")
    measures = ["correct", "total", "rules", "facts"]
    filled = sizes.fillna(0, subset=measures)
    running = running_totals(filled, keys, ["batch"], measures, "progress")
    upto = lambda m: F.col(f"{m}_before") + F.col(m)
    return running.select(
        *keys, "batch", "articles",
        upto("total").alias("total_episodes"),
        F.coalesce(F.try_divide(upto("correct"), upto("total")), F.lit(0.0)).alias("accuracy"),
        upto("facts").alias("memory_facts"),
        upto("rules").alias("active_rules"),
    )


def resolved_per_batch(episodes: DataFrame, keys: list[str]) -> DataFrame:
    return (
        episodes.filter("was_correct IS NOT NULL")
        .groupBy(*keys, "batch")
        .agg(F.sum(F.col("was_correct").cast("long")).alias("correct"), F.count("*").alias("total"))
    )
