"""Prediction, article and metrics files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import once
from tidemark.functions.text import first_filled, run_seconds

PREDICTION_SCHEMA = (
    "status string, success boolean, article_idx long, date string, title string, source string, "
    "signal variant, signal_vector_clean variant, time_seconds double, time_ms double, error string"
)
ARTICLE_SCHEMA = "article_idx long, title string, text string, date string, source string"


def read_predictions(spark: SparkSession, paths, strict: bool = False) -> DataFrame:
    """Prediction lines. Blank lines and lines that are not JSON objects are skipped, or, with
    ``strict``, a broken line fails the read. A field of another type is read as its own type
    where it can be (``"2"`` and ``2.0`` are 2) and is null otherwise; the line stays."""
    return _fields(spark.read.text(paths), strict)


def _fields(lines: DataFrame, strict: bool = False, *keep: Column) -> DataFrame:
    """The fields of text lines of JSON objects, and the columns in ``keep``."""
    filled = lines.filter(F.trim("value") != "")
    parsed = once(filled, "_line", F.parse_json("value") if strict else F.try_parse_json("value"))
    objects = parsed.filter(F.schema_of_variant("_line").startswith("OBJECT"))

    def field(name: str, kind: str) -> Column:
        path = f"$.{name}"
        if kind == "variant":
            found = F.try_variant_get("_line", path, "variant")
        elif kind == "long":
            exact = F.try_variant_get("_line", path, "long")
            found = F.coalesce(exact, F.try_variant_get("_line", path, "double").try_cast("long"))
        else:
            found = F.try_variant_get("_line", path, kind)
        return found.alias(name)

    fields = [part.split() for part in PREDICTION_SCHEMA.split(", ")]
    return objects.select(*[field(name, kind) for name, kind in fields], *keep)


def successful(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("status") == "success")


def served(predictions: DataFrame) -> DataFrame:
    """Rows a dashboard serves: success by status or flag, ordered by date, missing dates first."""
    return predictions.filter((F.col("status") == "success") | F.col("success")).orderBy(
        F.coalesce("date", F.lit("")), "article_idx"
    )


def read_models(spark: SparkSession, folder: str, files: dict[str, str], strict: bool = False) -> DataFrame:
    """Many model files in one read, labelled by the name of the file, without its ending, or of a
    folder it is in; files not named are left out and missing ones simply have no rows. With
    ``strict`` a broken line of a named file fails the read; :func:`broken_lines` lists them."""
    return _fields(model_lines(spark, folder, files), strict, F.col("config"))


def broken_lines(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """``config, line``: the lines, blank ones aside, on which a strict read of the files fails."""
    filled = model_lines(spark, folder, files).filter(F.trim("value") != "")
    return filled.filter(F.try_parse_json("value").isNull()).select("config", F.col("value").alias("line"))


def model_lines(spark: SparkSession, folder: str, files: dict[str, str]) -> DataFrame:
    """``value, config``: the text lines of the named files."""
    lines = (
        spark.read.option("recursiveFileLookup", "true")
        .text(folder)
        .select("value", F.split(F.col("_metadata.file_path"), "/").alias("_path"))
    )
    names = F.concat(
        F.slice("_path", F.lit(1), F.size("_path") - 1),
        F.array(F.regexp_replace(F.element_at("_path", -1), r"\..*$", "")),
    )
    label = F.lit(None).cast("string")
    for name, part in files.items():
        label = F.when(F.array_contains(names, part), name).otherwise(label)
    return lines.withColumn("config", label).filter("config IS NOT NULL")


def usable(predictions: DataFrame) -> DataFrame:
    return predictions.filter(F.col("status").isin("success", "recovered"))


def read_articles(spark: SparkSession, path: str, first: int | None = None) -> DataFrame:
    """Article lines with an explicit ``article_idx``; ``first`` keeps the articles below it."""
    rows = spark.read.schema(ARTICLE_SCHEMA).json(path)
    return rows if first is None else rows.filter(F.col("article_idx") < first)


def remaining(articles: DataFrame, written: DataFrame, errors_count_as_done: bool = False) -> DataFrame:
    """Articles without a written prediction: an anti join on (config, article_idx)."""
    done = written if errors_count_as_done else successful(written)
    return articles.join(done.select("config", "article_idx"), ["config", "article_idx"], "left_anti")


def append_predictions(predictions: DataFrame, path: str) -> None:
    predictions.write.mode("append").partitionBy("config").json(path)


def experiment_grid(spark: SparkSession, models: list[str], temperatures: list[float]) -> DataFrame:
    """The model and temperature grid as a configuration dimension."""
    cells = [(f"{m}_t{t}", m, t) for m in models for t in temperatures]
    return spark.createDataFrame(cells, "config string, model string, temperature double")


def pending_work(articles: DataFrame, grid: list[str], written: DataFrame, first: int | None = None) -> DataFrame:
    """Every (config, article) still to be scored, the first ``first`` articles of each config.

    The grid is a short list held in the plan, so the articles are expanded in place.
    """
    wanted = articles if first is None else articles.filter(F.col("article_idx") < first)
    expanded = wanted.withColumn("config", F.explode(F.array(*[F.lit(c) for c in grid])))
    return remaining(expanded, written)


def metrics_documents(ic: DataFrame, accuracy: DataFrame, predictions: DataFrame) -> DataFrame:
    """One JSON document per configuration, as the metrics file holds them; p-values where ``ic`` has them."""
    fields = [c for c in ("ic", "p_value", "n") if c in ic.columns]
    by_horizon = ic.groupBy("config").agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct(F.col("horizon").cast("string"), F.struct(*fields))))
        ).alias("ic_by_horizon")
    )
    accuracy_doc = accuracy.select(
        "config", F.struct("accuracy", "correct", "total").alias("direction_accuracy_5d")
    )
    counts = predictions.groupBy("config").agg(F.count("*").alias("predictions"))
    joined = counts.join(by_horizon, "config").join(accuracy_doc, "config")
    return joined.select(
        "config",
        F.to_json(F.struct("predictions", "ic_by_horizon", "direction_accuracy_5d")).alias("document"),
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Stored metrics documents as (config, document); no rows where nothing was written."""
    try:
        return spark.read.schema("config string, document string").option("multiLine", "false").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "config string, document string")


def run_summary(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Processed, successful and failed rows and their times per configuration."""
    seconds = run_seconds(F.col("time_seconds"), F.col("time_ms"))
    return (
        predictions.groupBy(*keys)
        .agg(
            F.count("*").alias("processed"),
            F.count_if(F.col("status") == "success").alias("successes"),
            F.count_if(F.col("status") == "error").alias("errors"),
            F.sum(seconds).alias("total_seconds"),
            F.min(seconds).alias("min_seconds"),
            F.max(seconds).alias("max_seconds"),
        )
        .withColumn("success_rate", F.try_divide("successes", "processed"))
        .withColumn("avg_seconds", F.try_divide("total_seconds", "processed"))
    )


def article_text(title, description):
    """Title and description as one text."""
    return F.concat_ws(". ", title, F.coalesce(description, F.lit("")))


def imported(raw: DataFrame, column: str = "item"):
    """Fields of an imported note from a Variant row: text from the first filled of text, content
    and body; rows without any are left out; the other fields stay as metadata."""
    get = lambda name: F.try_variant_get(column, f"$.{name}", "string")
    text = first_filled(get("text"), get("content"), get("body"))
    fields = F.map_filter(
        F.try_variant_get(column, "$", "map<string,variant>"),
        lambda k, v: ~k.isin("text", "content", "body"),
    )
    return raw.select(
        text.alias("text"),
        F.coalesce(get("source"), F.lit("manual_note")).alias("source"),
        F.coalesce(get("title"), F.lit("")).alias("title"),
        F.coalesce(get("url"), F.lit("")).alias("url"),
        first_filled(get("date"), get("observed_at")).alias("observed_at"),
        F.to_json(F.map_from_entries(F.array_sort(F.transform(
            F.map_entries(fields),
            lambda e: F.struct(e["key"].alias("key"), F.to_json(e["value"]).alias("value")),
        )))).alias("metadata"),
    ).filter("text IS NOT NULL")
