"""The ingestion cycle and the feedback loop, composed from the other operators."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import signals as sg
from tidemark.functions.columns import once
from tidemark.functions.scoring import score_articles
from tidemark.functions.text import direction
from tidemark.operators import episodes as ep
from tidemark.operators import rules as ru
from tidemark.session import materialise
from tidemark.sources.feeds import rss_articles, unseen_articles
from tidemark.sources.predictions import article_text

#: Items of one feed that have numbers of their own.
ITEMS_PER_FEED = 1 << 20


def recorded_answers(answers: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A model whose answers (``title, response``, one row per title) were given before."""

    def respond(asked: DataFrame) -> DataFrame:
        known = answers.select(F.sha2("title", 256).alias("_title"), "response")
        return asked.join(known, F.sha2(asked["title"], 256) == F.col("_title"), "left").drop("_title")

    return respond


def answering(score: Callable[[pd.DataFrame], pd.Series]) -> Callable[[DataFrame], DataFrame]:
    """A model that is a caller's own function over pandas frames, context included."""
    return lambda asked: score_articles(asked, score)


def ingestion_cycle(
    payloads: DataFrame,
    history: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    respond: Callable[[DataFrame], DataFrame],
    as_of: Column,
    model: str,
) -> dict[str, DataFrame]:
    """One turn over RSS payloads (``seq, source, payload``): the tables it adds, by name.

    ``articles`` are all items with a title. Those whose title is neither in the ``history``
    (``article_title``) nor earlier in the turn are ``asked``: with title and description as text and
    the context that ``retrieve`` finds for them (``query_id, packed`` for ``query_id, source, text``).
    ``respond`` adds the column ``response``. ``signals`` are the answers that hold a signal vector, as
    stored: header, vector, reasoning and the direction of each ticker. An answer without one, or
    that cannot be read, stores nothing, and its article is asked again in a later turn.

    Every table is written before it is returned, so that the model is asked once per article.
    """
    found = rss_articles(payloads, keep=["seq"])
    articles = materialise(found.withColumn("seq", F.col("seq") * ITEMS_PER_FEED + F.col("pos")), "articles")
    fresh = unseen_articles(articles, history).withColumn("text", article_text(F.col("title"), F.col("description")))
    fresh = materialise(fresh.select("seq", "source", "title", "published", "text"), "fresh")
    context = retrieve(fresh.select(F.col("seq").alias("query_id"), "source", "text"))
    asked = fresh.join(context.select(F.col("query_id").alias("seq"), F.col("packed").alias("context")), "seq", "left")
    answered = materialise(respond(asked.withColumn("context", F.coalesce("context", F.lit("")))), "answered")
    parsed = once(answered, "signal", sg.parse_span(F.col("response")))
    vector = sg.field(F.col("signal"), "$.signal_vector")
    scored = once(parsed.withColumn("vector", vector), "scores", sg.strict_scores(F.col("vector"))).filter(F.size("scores") > 0)
    dated = F.coalesce(F.nullif("published", F.lit("")), F.date_format(as_of, "yyyy-MM-dd"))
    stored = scored.select(
        F.col("seq").alias("id"), dated.alias("article_date"), F.col("title").alias("article_title"),
        F.col("source").alias("article_source"), F.to_json("vector").alias("signal_vector"),
        F.coalesce(F.try_variant_get("signal", "$.chain_of_thought", "string"), F.lit("")).alias("reasoning"),
        F.map_from_entries(F.transform(
            "scores", lambda e: F.struct(e["ticker"].alias("ticker"), direction(F.coalesce(e["score"], F.lit(0.0))).alias("direction"))
        )).alias("predicted_direction"),
        F.lit(model).alias("model_used"), F.lit(None).cast("boolean").alias("was_correct"), as_of.cast("timestamp").alias("created_at"),
    )
    return {"articles": articles, "asked": answered, "signals": materialise(stored, "signals")}


def cycle_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Articles fetched and signals generated in a turn, as one row."""
    return tables["articles"].agg(F.count("*").alias("articles_fetched")).withColumn(
        "signals_generated", tables["signals"].agg(F.count("*")).scalar()
    )


def feedback_loop(
    signals: DataFrame, panel: DataFrame, stored_rules: DataFrame, as_of: Column, horizon: int = 5
) -> dict[str, DataFrame]:
    """One turn of the loop: outcomes, accuracy by category, new rules and the merged store.

    Every ticker is recorded with its own return.
    """
    recorded = materialise(ep.record_episodes(signals, panel, horizon), "episodes")
    new_rules = ru.generate_rules(recorded, as_of)
    stored = ru.upsert_rules(stored_rules, new_rules)
    return {
        "episodes": recorded,
        "accuracy": ep.accuracy_by_category(recorded),
        "new_rules": new_rules,
        "rules": stored,
        "active_rules": ru.active_rules(stored),
    }


def lexicon_counts(texts: DataFrame, keys: list[str], words: dict[str, list[str]], text: str = "reasoning") -> DataFrame:
    """Tokens of each word list in a text, summed per key (``bullish`` and ``bearish`` words, say).

    The lists are short and fixed, so each text is counted where it is read.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))

    def hits(listed: list[str]) -> Column:
        return F.size(F.filter(tokens, lambda word: word.isin(listed)))

    return texts.groupBy(*keys).agg(*[F.sum(hits(listed)).alias(name) for name, listed in words.items()])
