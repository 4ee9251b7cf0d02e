"""Queries over episodes, rules and the walk-forward loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import episodes as ep
from tidemark.operators import rules as ru
from tidemark.plans import bindings as b
from tidemark.plans.book import BOOK
from tidemark.plans.evaluation import raw_sql, rounded
from tidemark.session import materialise

EPISODE_CTES = raw_sql(b.FIVE_BRANDS, horizons=[5]) + "," + b.EPISODES_SQL


def loop_episodes(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    """Episodes of the five main tickers with their batch number."""
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS).withColumn("batch", ru.batch_of(F.col("article_idx")))
    return ep.record_episodes(signals, b.market_panel(spark, sf_dir, [5]), **options)


@BOOK.add(
    "episodes",
    EPISODE_CTES + """
SELECT config, article_idx, date, source, ticker, predicted_score, round(actual_return, 6) + 0.0 AS actual_return,
       predicted_direction, actual_direction, was_correct FROM episodes""",
)
def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(loop_episodes(spark, sf_dir), "actual_return").select(
        "config", "article_idx", "date", "source", "ticker", "predicted_score", "actual_return",
        "predicted_direction", "actual_direction", "was_correct",
    )


@BOOK.add(
    "accuracy_by_category",
    EPISODE_CTES + "," + b.category_sql(keep="config,") + """
SELECT config, family, key, correct, total, round(correct / total, 6) AS accuracy FROM counts""",
)
def accuracy_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ep.accuracy_by_category(loop_episodes(spark, sf_dir), ["config"]), "accuracy")


# Outcomes that differ by source, ticker and direction, so that every family of rules fires. The
# same text is read by Spark and by DuckDB.
PLANTED = """CASE WHEN source LIKE '1-%' THEN article_idx % 10 < 8 WHEN source LIKE '5-%' THEN article_idx % 10 < 2
  WHEN ticker = 'Brand#1' THEN article_idx % 10 < 9 WHEN ticker = 'Brand#2' THEN article_idx % 10 < 1
  WHEN predicted_direction = 'bullish' THEN article_idx % 10 < 8 ELSE article_idx % 10 < 2 END"""
PLANTED_CTES = (
    EPISODE_CTES.replace("\nepisodes AS (", "\nseen AS (")
    + f",\nepisodes AS (SELECT * REPLACE ({PLANTED} AS was_correct) FROM seen)"
)


def planted_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return loop_episodes(spark, sf_dir).withColumn("was_correct", F.expr(PLANTED))


@BOOK.add(
    "rule_generation",
    PLANTED_CTES + "," + b.category_sql(keep="config,") + "," + b.rules_sql("counts", "config,") + "\nSELECT * FROM rules",
)
def rule_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules per configuration from all episodes, with outcomes that make every family fire."""
    rules = ru.generate_rules(planted_episodes(spark, sf_dir), F.current_date(), ["config"])
    return rounded(rules, "confidence").select(
        "config", "rule_id", "rule_text", "confidence", "evidence_count", "category"
    )


UPSERT_SQL = (
    PLANTED_CTES + "," + b.category_sql(where="date < DATE '1998-01-01'").replace("counts AS", "old_counts AS")
    + "," + b.rules_sql("old_counts").replace("rules AS", "old_rules AS")
    + "," + b.category_sql()
    + "," + b.rules_sql("counts")
)


@BOOK.add(
    "rule_upsert",
    UPSERT_SQL + """
SELECT coalesce(o.rule_id, r.rule_id) AS rule_id, coalesce(r.rule_text, o.rule_text) AS rule_text,
       coalesce(r.confidence, o.confidence) AS confidence, coalesce(r.evidence_count, o.evidence_count) AS evidence_count,
       CASE WHEN o.rule_id IS NULL THEN DATE '2002-01-01' ELSE DATE '1998-01-01' END AS created_at,
       CASE WHEN r.rule_id IS NULL THEN DATE '1998-01-01' ELSE DATE '2002-01-01' END AS last_validated,
       coalesce(o.category, r.category) AS category
FROM old_rules o FULL OUTER JOIN rules r ON o.rule_id = r.rule_id""",
)
def rule_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules learned up to 1998 merged with those of the whole period."""
    seen = materialise(planted_episodes(spark, sf_dir), "episodes")
    first = F.lit("1998-01-01").cast("date")
    old = ru.generate_rules(seen.filter(F.col("date") < first), first)
    new = ru.generate_rules(seen, F.lit("2002-01-01").cast("date"))
    return rounded(ru.upsert_rules(old, new), "confidence")


@BOOK.add(
    "active_rules",
    EPISODE_CTES + "," + b.category_sql(keep="config,") + "," + b.rules_sql("counts", "config,") + """
SELECT config, rule_id, confidence, evidence_count,
       CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS label
FROM rules WHERE confidence >= 0.5""",
)
def active_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ru.generate_rules(loop_episodes(spark, sf_dir), F.current_date(), ["config"])
    return rounded(ru.active_rules(rules), "confidence").select(
        "config", "rule_id", "confidence", "evidence_count",
        ru.confidence_label(F.col("confidence")).alias("label"),
    )


@BOOK.add(
    "rules_context",
    EPISODE_CTES + "," + b.category_sql(keep="config,") + "," + b.rules_sql("counts", "config,") + """
SELECT config, '[BEHAVIORAL RULES LEARNED FROM EXPERIENCE]' || chr(10) || string_agg(
         '  [' || CASE WHEN confidence >= 0.8 THEN 'HIGH' WHEN confidence >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END
         || ' confidence, ' || evidence_count || ' observations] ' || rule_text, chr(10)
         ORDER BY confidence DESC, rule_id) AS rules_text
FROM rules WHERE confidence >= 0.5 GROUP BY config""",
)
def rules_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = ru.generate_rules(loop_episodes(spark, sf_dir), F.current_date(), ["config"])
    return ru.rules_text(rounded(rules, "confidence"), ["config"])


HISTORY_SQL = (
    EPISODE_CTES + "," + b.category_sql(keep="config, batch,").replace("counts AS", "per_batch AS") + """,
counts AS (
  SELECT config, batch, family, key,
         CAST(sum(correct) OVER (PARTITION BY config, family, key ORDER BY batch) AS BIGINT) AS correct,
         CAST(sum(total) OVER (PARTITION BY config, family, key ORDER BY batch) AS BIGINT) AS total
  FROM per_batch),""" + b.rules_sql("counts", "config, batch,")
)


@BOOK.add(
    "walk_forward_rules",
    HISTORY_SQL + """
SELECT config, batch, batch + 1 AS usable_from, rule_id, rule_text, confidence, evidence_count, category FROM rules""",
)
def walk_forward_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ru.rule_history(loop_episodes(spark, sf_dir), ["config"]), "confidence")


@BOOK.add(
    "cumulative_accuracy",
    HISTORY_SQL + """,
sizes AS (SELECT o_orderstatus AS config, o_orderkey // 50 AS batch, count(*) AS articles FROM orders GROUP BY ALL),
facts AS (SELECT config, batch, count(*) AS facts FROM pred_batch WHERE abs(score) >= 0.5 GROUP BY ALL),
outcome AS (SELECT config, batch, count_if(was_correct) AS correct, count(*) AS total FROM episodes GROUP BY ALL),
fired AS (SELECT config, batch, count(*) AS rules FROM (
  SELECT config, rule_id, min(batch) AS batch FROM rules GROUP BY ALL) GROUP BY ALL),
joined AS (
  SELECT s.config, s.batch, s.articles, coalesce(f.facts, 0) AS facts, coalesce(o.correct, 0) AS correct,
         coalesce(o.total, 0) AS total, coalesce(r.rules, 0) AS rules
  FROM sizes s LEFT JOIN facts f ON s.config = f.config AND s.batch = f.batch
  LEFT JOIN outcome o ON s.config = o.config AND s.batch = o.batch
  LEFT JOIN fired r ON s.config = r.config AND s.batch = r.batch)
SELECT config, batch, articles, CAST(sum(total) OVER w AS BIGINT) AS total_episodes,
       coalesce(round(sum(correct) OVER w / nullif(sum(total) OVER w, 0), 6), 0) AS accuracy,
       CAST(sum(facts) OVER w AS BIGINT) AS memory_facts, CAST(sum(rules) OVER w AS BIGINT) AS active_rules
FROM joined WINDOW w AS (PARTITION BY config ORDER BY batch)""".replace(
        "FROM pred_batch", "FROM (SELECT *, article_idx // 50 AS batch FROM pred)"
    ),
)
def cumulative_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's report after each batch."""
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS).withColumn("batch", ru.batch_of(F.col("article_idx")))
    seen = materialise(loop_episodes(spark, sf_dir), "episodes")
    facts = signals.filter(F.abs("score") >= 0.5).groupBy("config", "batch").agg(F.count("*").alias("facts"))
    sizes = (
        b.table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderstatus").alias("config"), ru.batch_of(F.col("o_orderkey")).alias("batch"))
        .agg(F.count("*").alias("articles"))
    )
    batches = sizes.join(facts, ["config", "batch"], "left")
    progress = ru.batch_progress(seen, batches, ru.rule_history(seen, ["config"]), ["config"])
    return rounded(progress, "accuracy")


@BOOK.add(
    "similar_episodes",
    EPISODE_CTES + """
SELECT ticker, source, pos, date, article_idx, config, was_correct FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY ticker, source ORDER BY date DESC, article_idx) AS INTEGER) AS pos FROM episodes)
WHERE pos <= 3""",
)
def similar_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = ep.latest_episodes(loop_episodes(spark, sf_dir), ["ticker", "source"], 3, [F.asc("article_idx")])
    return latest.select("ticker", "source", "pos", "date", "article_idx", "config", "was_correct")


@BOOK.add(
    "accuracy_counts",
    EPISODE_CTES + """
SELECT CAST(count_if(e.was_correct) AS BIGINT) AS correct, CAST(count_if(NOT e.was_correct) AS BIGINT) AS incorrect,
       CAST(count_if(e.was_correct IS NULL) AS BIGINT) AS pending,
       round(count_if(e.was_correct) / count(e.was_correct), 6) AS accuracy
FROM pred p LEFT JOIN episodes e ON p.article_idx = e.article_idx AND p.ticker = e.ticker""",
)
def accuracy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals with the outcome their episode gives them; those without one are pending."""
    signals = b.predictions(spark, sf_dir, b.FIVE_BRANDS)
    outcomes = loop_episodes(spark, sf_dir).select("article_idx", "ticker", "was_correct")
    history = signals.join(outcomes, ["article_idx", "ticker"], "left")
    return rounded(ep.accuracy_counts(history), "accuracy")


@BOOK.add(
    "outcome_maturation",
    "WITH " + b.MARKET_SQL + "," + b.predictions_sql(b.FIVE_BRANDS) + """,
idx AS (SELECT ticker, date, close, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i,
               count(*) OVER (PARTITION BY ticker) AS cnt FROM market),
started AS (SELECT p.*, m.date AS start_date FROM pred p ASOF JOIN market m ON p.ticker = m.ticker AND p.date <= m.date
            WHERE abs(p.score) >= 0.3),
ended AS (SELECT s.ticker, s.source, e.date AS available_on FROM started s JOIN idx a ON a.ticker = s.ticker AND a.date = s.start_date
          JOIN idx e ON e.ticker = s.ticker AND e.i = least(a.i + 5, a.cnt - 1) WHERE e.i > a.i)
SELECT source, count(*) AS episodes, CAST(count_if(available_on <= DATE '1999-06-30') AS BIGINT) AS matured FROM ended GROUP BY source""",
)
def outcome_maturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes whose outcome is known on a day: what a caller without look-ahead may see."""
    matured = F.col("available_on") <= F.lit("1999-06-30").cast("date")
    return loop_episodes(spark, sf_dir).groupBy("source").agg(
        F.count("*").alias("episodes"), F.count_if(matured).alias("matured")
    )


@BOOK.add(
    "zero_policy",
    "WITH " + b.MARKET_SQL + "," + b.returns_sql("market", "ret", [5]) + "," + b.predictions_sql(b.FIVE_BRANDS) + """,
pairs AS (
  SELECT p.ticker, p.score, CASE WHEN r.date < DATE '1998-01-01' THEN r.ret ELSE 0 END AS ret
  FROM (SELECT p.*, m.date AS start_date FROM pred p ASOF JOIN market m ON p.ticker = m.ticker AND p.date <= m.date) p
  JOIN ret r ON r.ticker = p.ticker AND r.date = p.start_date WHERE abs(p.score) >= 0.3)
SELECT ticker, CASE WHEN ret > 0 THEN 'bullish' WHEN ret < 0 THEN 'bearish' ELSE 'neutral' END AS actual_direction, count(*) AS n
FROM pairs GROUP BY ALL""",
)
def zero_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directions under the neutral policy, with prices frozen from 1998 on."""
    panel = b.market_panel(spark, sf_dir, [5]).withColumn(
        "ret_5", F.when(F.col("ret_5").isNotNull() & (F.col("date") >= F.lit("1998-01-01").cast("date")), 0.0).otherwise(F.col("ret_5"))
    )
    seen = ep.record_episodes(b.predictions(spark, sf_dir, b.FIVE_BRANDS), panel, zero_policy="neutral")
    return seen.groupBy("ticker", "actual_direction").agg(F.count("*").alias("n"))
