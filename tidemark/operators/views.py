"""Listings behind a dashboard: model lists, event indexes, price windows and signal cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.columns import let
from tidemark.functions.text import run_seconds, signed
from tidemark.operators.prefix import running_totals
from tidemark.operators.returns import join_as_of
from tidemark.session import materialise


def model_list(predictions: DataFrame, live_models: list[str]) -> DataFrame:
    """Models with their prediction counts and whether they can be run live."""
    return predictions.groupBy("config").agg(F.count("*").alias("predictions")).withColumn(
        "live_inference", F.col("config").isin(live_models)
    )


def prediction_index(predictions: DataFrame) -> DataFrame:
    """Place of each prediction within its model by (date, article), from 0.

    A model may hold any share of the rows, so the place is a running total, not one sort.
    """
    counted = predictions.withColumn("_one", F.lit(1).cast("long"))
    running = running_totals(counted, ["config"], ["date", "article_idx"], ["_one"], "index")
    return running.withColumnRenamed("_one_before", "idx").drop("_one", "_one_total")


def price_windows(prices: DataFrame, rows: int = fixed.PRICE_WINDOW_ROWS) -> DataFrame:
    """For each price row, the ``rows`` days and closes from it on: a fixed number per row."""
    ahead = Window.partitionBy("ticker").orderBy("date").rowsBetween(0, rows - 1)
    return prices.select(
        "ticker", "date",
        F.collect_list("date").over(ahead).alias("dates"),
        F.collect_list("close").over(ahead).alias("closes"),
    )


def event_price_windows(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Each event with the price window from its as-of row on. ``windows`` is a written result
    of :func:`price_windows`, so a window is built once per price row; it is attached when the
    first row of an event is known, so the lookup by day carries no arrays."""
    started = join_as_of(events, windows.select("ticker", "date"), [])
    return started.join(windows.withColumnRenamed("date", "start_date"), ["ticker", "start_date"])


def window_rows(events: DataFrame, prices: DataFrame, rows: int = fixed.PRICE_WINDOW_ROWS) -> DataFrame:
    """Each event with its price window in long form: ``start_date``, ``place`` from 0, ``price_date``
    and ``close``.

    Price rows are numbered and cut into ranges as long as a window, so a window lies in two ranges
    at most and the rows are found by an equi join on (ticker, range); no arrays are built.
    """
    number = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    numbered = materialise(prices.select("ticker", "date", "close", number.alias("_i")), "numbered")
    started = join_as_of(events, numbered, ["_i"])
    first = F.floor(F.col("_i") / rows)
    wanted = started.withColumn("_range", F.explode(F.array(first, first + 1)))
    given = numbered.select(
        "ticker", F.floor(F.col("_i") / rows).alias("_range"), F.col("_i").alias("_at"), F.col("date").alias("price_date"), "close"
    )
    found = wanted.join(given, ["ticker", "_range"]).filter(F.col("_at").between(F.col("_i"), F.col("_i") + rows - 1))
    return found.withColumn("place", F.col("_at") - F.col("_i")).drop("_i", "_at", "_range")


def compare_models(
    predictions: DataFrame,
    models: list[str],
    value: str = "score",
    keys: list[str] = ["article_idx"],
    order: list[str] = ["date"],
) -> DataFrame:
    """One row per article with each model's value side by side: that of its first row by
    ``order``, and of equal first rows the least value."""
    return predictions.groupBy(*keys).pivot("config", models).agg(F.min_by(value, F.struct(*order, value)))


def signal_card(predictions: DataFrame, keep: list[str], least: float | None = 0.01) -> DataFrame:
    """Scores of each prediction (``scores``, an array of ticker and score) with their bar width in
    percent of its largest (at least 1), a row each. ``least=None`` keeps all scores (the
    comparison form). All is worked out within the row, so nothing is shuffled."""

    def bars(widest: Column) -> Column:
        shown = F.col("scores") if least is None else F.filter("scores", lambda e: F.abs(e["score"]) > least)
        return F.transform(shown, lambda e: F.struct(e["ticker"], e["score"], (F.abs(e["score"]) / widest * 100).alias("width")))

    widest = F.greatest(F.array_max(F.transform("scores", lambda e: F.abs(e["score"]))), F.lit(1.0))
    return predictions.select(*keep, F.inline(let(widest, bars)))


def signal_chips(predictions: DataFrame, keep: list[str], least: float = 0.05) -> DataFrame:
    """Short texts ``T +1.2`` of the scores worth showing, in ticker order, as one line; predictions
    without any are left out."""
    shown = F.array_sort(F.filter("scores", lambda e: F.abs(e["score"]) >= least))
    chips = F.transform(shown, lambda e: F.concat(e["ticker"], F.lit(" "), signed(e["score"], 1)))
    return predictions.select(*keep, F.array_join(chips, ", ").alias("chips")).filter("chips <> ''")


def tickers_found(predictions: DataFrame, keep: list[str]) -> DataFrame:
    """Number of scored tickers and the best score per prediction; those without any are left out."""
    found = F.filter("scores", lambda e: e["score"] != 0)
    best = F.array_max(F.transform(found, lambda e: e["score"]))
    counted = predictions.select(*keep, F.size(found).cast("long").alias("tickers_found"), best.alias("top_score"))
    return counted.filter("tickers_found > 0")


def with_seconds(predictions: DataFrame) -> DataFrame:
    return predictions.withColumn("seconds", run_seconds(F.col("time_seconds"), F.col("time_ms")))


def first_predictions(
    predictions: DataFrame, models: list[str], order: list[str], fields: list[str] = ["signal", "seconds"]
) -> DataFrame:
    """One row per article with, for each model, the ``fields`` of its first row by ``order`` (that
    must tell the rows of an article apart), as ``<model>_<field>``; null where it has none.

    The place of the first row is found on narrow columns, and its fields are fetched then.
    """
    keys = ["config", "article_idx"]
    place = F.struct(*order)
    first = predictions.groupBy(*keys).agg(F.min(place).alias("_first"))
    rows = predictions.withColumn("_first", place).join(first, [*keys, "_first"])
    wide = rows.groupBy("article_idx").pivot("config", models).agg(F.first(F.struct(*fields)))
    return wide.select("article_idx", *[F.col(f"`{m}`.{f}").alias(f"{m}_{f}") for m in models for f in fields])
