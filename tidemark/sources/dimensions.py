"""Small fixed dimensions: companies, sector map, triggers, seed facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed


def companies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.COMPANIES, "ticker string, name string, sec_cik string, orgs array<string>, assignee string"
    )


def sector_tickers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.SECTOR_TICKERS, "ticker string, name string, technology string, signal_weight double, cluster string"
    )


def sector_clusters(spark: SparkSession) -> DataFrame:
    """Tickers of each cluster; the map is a fixed list, so the lists are short."""
    return sector_tickers(spark).groupBy("cluster").agg(F.array_sort(F.collect_list("ticker")).alias("tickers"))


def sector_triggers(spark: SparkSession) -> DataFrame:
    """One row per trigger and ticker with effect +1 (bullish) or -1 (bearish)."""
    rows = spark.createDataFrame(
        fixed.SECTOR_TRIGGERS, "trigger string, bullish array<string>, bearish array<string>"
    )
    effects = F.concat(
        F.transform("bullish", lambda t: F.struct(t.alias("ticker"), F.lit(1).alias("effect"))),
        F.transform("bearish", lambda t: F.struct(t.alias("ticker"), F.lit(-1).alias("effect"))),
    )
    return rows.select("trigger", F.explode(effects).alias("e")).select("trigger", "e.*")


def sector_lines(spark: SparkSession) -> DataFrame:
    """The sector text block as numbered lines."""
    lines = ["Quantum computing ticker universe:", "Active pure plays:"]
    lines += [f"- {k}: {name}, {tech}, score range +/-{cap}" for k, name, tech, cap in fixed.ACTIVE_PROFILES]
    lines.append("Adjacent active tickers:")
    lines += [f"- {k}: {name}, {tech}, capped at +/-{cap}" for k, name, tech, cap in fixed.ADJACENT_PROFILES]
    lines.append("Inactive tickers:")
    lines += [
        f"- {k}: always 0.0 unless the user explicitly changes scope. Reason: {why}"
        for k, why in fixed.INACTIVE_PROFILES
    ]
    lines.append("Technology dynamics:")
    lines += [f"- {topic}: {rule}" for topic, rule in fixed.TECHNOLOGY_DYNAMICS]
    return spark.createDataFrame(list(enumerate(lines)), "line_no int, line string")


def sector_text(spark: SparkSession) -> DataFrame:
    """The block as one text: a fixed, short list of lines."""
    return sector_lines(spark).agg(F.expr("listagg(line, '\\n') WITHIN GROUP (ORDER BY line_no)").alias("text"))


def seed_facts(spark: SparkSession, confidence: float = 0.9) -> DataFrame:
    facts = spark.createDataFrame(fixed.SEED_FACTS, "ticker string, fact_type string, content string")
    return facts.withColumns({"source": F.lit("seed"), "confidence": F.lit(confidence)})


def with_company(rows: DataFrame) -> DataFrame:
    """Company fields by ticker; the dimension has a fixed ten rows."""
    return rows.join(F.broadcast(companies(rows.sparkSession)), "ticker", "left")


def with_sector(rows: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(sector_tickers(rows.sparkSession)), "ticker", "left")
