"""Context and prompt text built from rules, episodes, facts and search hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import filled, signed, whole_percent
from tidemark.operators.episodes import latest_episodes
from tidemark.operators.facts import cut, latest_facts, latest_signals
from tidemark.operators.prefix import running_totals
from tidemark.operators.rules import rules_text
from tidemark.operators.topk import joined_text, top_k
from tidemark.session import materialise

#: Tickers of a query that its sections are made from.
LEADING_TICKERS = 3
#: Characters of packed texts that every task may hold.
BROADCAST_CHARS = 1 << 22


def pack_sections(sections: DataFrame, key: str, order: str, text: str, max_chars: int) -> DataFrame:
    """The leading sections of each group that fit ``max_chars`` when joined by line breaks.

    Sections are dropped whole from the end. Lengths alone are added up as running totals, so a
    group may have any number of sections; the texts of those kept are fetched last, and joined
    they are at most ``max_chars`` long.
    """
    written = materialise(sections.select(key, order, text), "sections")
    sized = written.select(key, order, (F.length(text) + 1).alias("_size"))
    running = running_totals(sized, [key], [order], ["_size"], "sections")
    places = running.filter(F.col("_size_before") + F.col("_size") - 1 <= max_chars).select(key, order)
    # Files of repeated texts are far smaller than the texts, so their size must not get them broadcast.
    kept = written.hint("merge").join(places, [key, order])
    packed = kept.groupBy(key).agg(
        F.count("*").alias("sections"), joined_text(order, text, "\n").alias("packed")
    )
    return (
        written.select(key)
        .distinct()
        .join(packed, key, "left")
        .select(key, F.coalesce("sections", F.lit(0)).alias("sections"), F.coalesce("packed", F.lit("")).alias("packed"))
    )


def query_tickers(queries: DataFrame, tickers: str = "tickers", first: int = LEADING_TICKERS) -> DataFrame:
    """One row per query and mentioned ticker, the first few, with its place in the list."""
    return queries.select(
        "query_id", "source", F.posexplode(F.slice(tickers, 1, first)).alias("place", "ticker")
    )


def fact_sections(queries: DataFrame, facts: DataFrame, as_of: Column, fetched: int = 5, used: int = 3) -> DataFrame:
    """``[MEMORY: T] f1 | f2 | f3`` per query and ticker.

    The facts of a ticker are picked and joined once, not once per query; they are picked without
    their texts, which are fetched for those that are used.
    """
    narrow = facts.select("id", "ticker", "updated_at", "access_count", "expires_at")
    places = latest_facts(narrow, as_of, fetched).filter(F.col("pos") <= used).select("id", "pos")
    picked = facts.select("id", "ticker", "content").join(places, "id")
    lines = picked.groupBy("ticker").agg(joined_text("pos", "content", " | ").alias("facts"))
    return query_tickers(queries).join(lines, "ticker").select(
        "query_id",
        (10 + F.col("place")).alias("priority"),
        F.concat(F.lit("[MEMORY: "), F.col("ticker"), F.lit("] "), F.col("facts")).alias("section"),
    )


def past_signal_sections(queries: DataFrame, signals: DataFrame, fetched: int = 3, used: int = 2) -> DataFrame:
    """``[PAST SIGNAL ..]`` per query, ticker and recent signal that has an outcome."""
    picked = latest_signals(signals, fetched).filter(
        (F.col("pos") <= used) & F.col("outcome").isNotNull() & (F.col("outcome") != "")
    )
    line = F.concat(
        F.lit("[PAST SIGNAL: "), F.col("ticker"), F.lit(" on "), F.col("article_date").cast("string"),
        F.lit("] '"), F.col("article_title"), F.lit("' → Outcome: "), F.col("outcome"),
    )
    return query_tickers(queries, first=2).join(picked, "ticker").select(
        "query_id", (20 + F.col("place") * fetched + F.col("pos")).alias("priority"), line.alias("section")
    )


def track_record(accuracy: DataFrame) -> DataFrame:
    """``[YOUR TRACK RECORD] Accuracy: ..`` from one row of accuracy counts; empty without any."""
    decided = F.col("correct") + F.col("incorrect")
    text = filled(
        fixed.TRACK_RECORD, percent=F.format_string("%.1f%%", F.bround(F.col("accuracy") * 100, 1)),
        correct=F.col("correct").cast("string"), total=decided.cast("string"),
    )
    return accuracy.filter(decided > 0).select(text.alias("section"))


def semantic_sections(
    queries: DataFrame, facts: DataFrame, signals: DataFrame, accuracy: DataFrame, as_of: Column
) -> DataFrame:
    """``query_id, priority, section`` of the semantic memory, most important first."""
    record = queries.select("query_id", F.lit(0).alias("priority"), track_record(accuracy).scalar().alias("section"))
    return (
        record.filter("section IS NOT NULL")
        .unionByName(fact_sections(queries, facts, as_of))
        .unionByName(past_signal_sections(queries, signals))
    )


def semantic_context(
    queries: DataFrame, facts: DataFrame, signals: DataFrame, accuracy: DataFrame, as_of: Column,
    max_tokens: int = 4000,
) -> DataFrame:
    """``query_id, packed``: the semantic sections that fit the budget.

    Beside the memory they depend on a query's leading tickers only, so they are built and packed
    once per list of tickers, and the texts are attached to the queries last.
    """
    leading = F.struct(F.slice("tickers", 1, LEADING_TICKERS).alias("tickers"))
    lists = queries.filter("query_id IS NOT NULL").groupBy("query_id").agg(F.array_sort(F.collect_list(leading)).alias("lists"))
    asked = materialise(lists.withColumn("list_id", F.sha2(F.to_json("lists"), 256)), "ticker-lists")
    different = materialise(asked.groupBy("list_id").agg(F.first("lists").alias("lists")), "different-lists")
    each = different.select(F.col("list_id").alias("query_id"), F.lit("").alias("source"), F.explode("lists").alias("_list"))
    sections = semantic_sections(each.select("query_id", "source", "_list.tickers"), facts, signals, accuracy, as_of)
    max_chars = max_tokens * fixed.CHARS_PER_TOKEN
    packed = pack_sections(sections, "query_id", "priority", "section", max_chars).select(F.col("query_id").alias("list_id"), "packed")
    if different.count() * max_chars <= BROADCAST_CHARS:
        packed = F.broadcast(packed)
    return (
        queries.select("query_id").join(asked.select("query_id", "list_id"), "query_id", "left")
        .join(packed, "list_id", "left").select("query_id", F.coalesce("packed", F.lit("")).alias("packed"))
    )


def experience_line() -> Column:
    """``[CORRECT] date ticker: Predicted .., actual ..`` of an episode, with its lesson if any."""
    return F.concat(
        F.lit("  ["), F.when(F.col("was_correct"), "CORRECT").otherwise("WRONG"), F.lit("] "),
        F.col("date").cast("string"), F.lit(" "), F.col("ticker"), F.lit(": Predicted "),
        F.col("predicted_direction"), F.lit(" ("), signed(F.col("predicted_score"), 1), F.lit("), actual "),
        signed(F.col("actual_return") * 100, 2), F.lit("%. "), F.coalesce("lesson", F.lit("")),
    )


def experience_block(queries: DataFrame, episodes: DataFrame, tie: list[Column], per_ticker: int = 3, used: int = 5) -> DataFrame:
    """``[PAST EXPERIENCES]`` per query: recent episodes of its tickers and source type.

    The episodes of a (ticker, source) are picked once and joined to the queries.
    """
    picked = latest_episodes(episodes, ["ticker", "source"], per_ticker, tie).select(
        "ticker", "source", "pos", experience_line().alias("line")
    )
    rows = query_tickers(queries).join(picked, ["ticker", "source"])
    leading = top_k(rows.withColumnRenamed("pos", "_pos"), ["query_id"], [F.asc("place"), F.asc("_pos")], used)
    return leading.groupBy("query_id").agg(
        F.concat(F.lit(fixed.EXPERIENCES_HEADER + "\n"), joined_text("pos", "line", "\n")).alias("experiences")
    )


def episode_prompt_lines(episodes: DataFrame, tie: list[Column], limit: int = 30, title_chars: int | None = None) -> DataFrame:
    """The latest resolved episodes as numbered lines for a rule-writing prompt."""
    line = F.concat(
        F.lit("- "), F.col("date").cast("string"), F.lit(" | "), F.col("ticker"), F.lit(" | Predicted: "),
        F.col("predicted_direction"), F.lit(" ("), signed(F.col("predicted_score"), 1), F.lit(") | Actual: "),
        F.col("actual_direction"), F.lit(" ("), signed(F.col("actual_return") * 100, 2), F.lit("%) | "),
        F.when(F.col("was_correct"), "CORRECT").otherwise("WRONG"), F.lit(" | Source: "), F.col("source"),
        F.lit(" | Article: "), cut(F.coalesce("title", F.lit("")), title_chars),
    )
    latest = episodes.filter("was_correct IS NOT NULL").orderBy(F.desc("date"), *tie).limit(limit)
    return latest.select("date", *[c for c in ("article_idx", "ticker") if c in episodes.columns], line.alias("line"))


def overall_record(counts: DataFrame) -> DataFrame:
    """``[YOUR TRACK RECORD] Overall accuracy ..`` from category counts; empty without episodes."""
    text = filled(
        fixed.OVERALL_TRACK_RECORD, percent=whole_percent(F.try_divide("correct", "total")),
        correct=F.col("correct").cast("string"), total=F.col("total").cast("string"),
    )
    return counts.filter("family = 'overall' AND total > 0").select(text.alias("section"))


def full_context(
    queries: DataFrame,
    rules: DataFrame,
    episodes: DataFrame,
    category_counts: DataFrame,
    semantic: DataFrame,
    tie: list[Column],
    max_tokens: int = 4000,
) -> DataFrame:
    """``query_id, context``: rules, experiences, semantic memory and track record.

    Non-empty parts are joined by blank lines and cut at the character budget with a note. The
    rules and the track record are one text for all queries and enter as scalar subqueries.
    """
    max_chars = max_tokens * fixed.CHARS_PER_TOKEN
    shortest_line = len("  [LOW confidence, 1 observations] ")
    rules_block = rules_text(rules, most_lines=max_chars // shortest_line + 1).select("rules_text").scalar()
    record = overall_record(category_counts).scalar()
    joined = (
        queries.select("query_id")
        .join(experience_block(queries, episodes, tie), "query_id", "left")
        .join(semantic.select("query_id", F.nullif("packed", F.lit("")).alias("semantic")), "query_id", "left")
        .withColumns({"rules": rules_block, "record": record})
        .withColumn("context", F.concat_ws("\n\n", "rules", "experiences", "semantic", "record"))
    )
    shortened = F.concat(F.left("context", F.lit(max_chars)), F.lit(fixed.TRUNCATION_SUFFIX))
    return joined.select(
        "query_id", F.when(F.length("context") > max_chars, shortened).otherwise(F.col("context")).alias("context")
    )


def memory_block(hits: DataFrame, records: DataFrame, chars: int | None = None) -> DataFrame:
    """``query_id, memory_block``: ``- [id] title: text`` of the hits, best first."""
    line = F.concat(
        F.lit("- ["), F.col("record_id"), F.lit("] "),
        F.coalesce(F.nullif("title", F.lit("")), F.col("source")), F.lit(": "), cut(F.col("text"), chars),
    )
    rows = hits.join(records.select("record_id", "title", "source", "text"), "record_id")
    return rows.select("query_id", "pos", line.alias("line")).groupBy("query_id").agg(
        joined_text("pos", "line", "\n").alias("memory_block")
    )


def prompts(queries: DataFrame, blocks: DataFrame) -> DataFrame:
    """``query_id, prompt`` with the retrieved memory, or a note that there is none."""
    memory = F.coalesce("memory_block", F.lit(fixed.NO_MEMORY_TEXT))
    prompt = filled(fixed.PROMPT, source=F.col("source"), memory=memory, text=F.col("text"))
    return queries.join(blocks, "query_id", "left").select("query_id", prompt.alias("prompt"))
