"""Forward returns and the as-of join of events to a daily price panel.

A panel has one row per (ticker, date). Dates are calendar days, so the rows of one ticker are
bounded by the length of the calendar and a window per ticker stays small at any data size.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.session import materialise


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("date")


def _whole_ticker():
    return _by_ticker().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def forward_returns(
    prices: DataFrame, horizons: list[int] = fixed.HORIZONS, strict_horizon: bool = False
) -> DataFrame:
    """Add ``ret_<h>``, ``rows_<h>`` (trading rows really used) and ``end_<h>`` (the day the
    outcome is known) for each horizon.

    The end row is ``h`` rows on, or the last row when the series ends sooner; with
    ``strict_horizon`` a shortened horizon gives null instead. The last row of a ticker and a
    zero start price give null. One pass serves all horizons.
    """
    left = F.count("*").over(_whole_ticker()) - F.row_number().over(_by_ticker())
    last_close = F.last("close").over(_whole_ticker())
    stage = prices.select(
        "ticker",
        "date",
        "close",
        left.alias("_left"),
        last_close.alias("_last"),
        F.last("date").over(_whole_ticker()).alias("_last_day"),
        *[F.lead("close", h).over(_by_ticker()).alias(f"_end_{h}") for h in horizons],
        *[F.lead("date", h).over(_by_ticker()).alias(f"_day_{h}") for h in horizons],
    )
    out: dict[str, Column] = {}
    for h in horizons:
        usable = (F.col("_left") > 0) & (F.col("close") != 0)
        if strict_horizon:
            usable = usable & (F.col("_left") >= h)
        end = F.coalesce(F.col(f"_end_{h}"), F.col("_last"))
        out[f"ret_{h}"] = F.when(usable, F.try_divide(end - F.col("close"), F.col("close")))
        out[f"rows_{h}"] = F.when(usable, F.least(F.col("_left"), F.lit(h)).cast("int"))
        out[f"end_{h}"] = F.when(usable, F.coalesce(F.col(f"_day_{h}"), F.col("_last_day")))
    return stage.select("ticker", "date", "close", *[c.alias(n) for n, c in out.items()])


def panel_start(*panels: DataFrame):
    """First date of written panels."""
    firsts = [p.agg(F.min("date")).first()[0] for p in panels]
    return min((f for f in firsts if f is not None), default=date(1970, 1, 1))


def calendar(panel: DataFrame, start) -> DataFrame:
    """Repeat each panel row for every day it answers: the days after the previous row up to it.

    The first row of a ticker answers from ``start``. The result has at most (tickers x calendar
    days) rows, and it turns the as-of lookup into an equi join.
    """
    opening = F.coalesce(F.date_add("_previous", 1), F.least(F.lit(start), F.col("date")))
    return (
        panel.withColumn("_previous", F.lag("date").over(_by_ticker()))
        .withColumn("as_of_day", F.explode(F.sequence(opening, F.col("date"))))
        .withColumnRenamed("date", "start_date")
        .drop("_previous")
    )


def join_calendar(events: DataFrame, days: DataFrame, first, how: str = "inner") -> DataFrame:
    """Attach to each event the calendar row of its ticker and day.

    Events after the last price find nothing. The join has no hint: the calendar comes from a
    written panel, so Spark knows its size and broadcasts it only below its own threshold. A larger
    one is shuffled by (ticker, day), which spreads a hot ticker over its days and lets AQE split
    a hot day; events are never sorted per ticker.
    """
    return (
        events.withColumn("as_of_day", F.greatest(F.col("date"), F.lit(first)))
        .join(days, ["ticker", "as_of_day"], how)
        .drop("as_of_day")
    )


def join_as_of(events: DataFrame, panel: DataFrame, keep: list[str], how: str = "inner") -> DataFrame:
    """Attach the first panel row of the ticker on or after the event date, as ``start_date``
    and the panel columns in ``keep``."""
    start = panel_start(panel)
    days = calendar(panel, start).select("ticker", "as_of_day", "start_date", *keep)
    return join_calendar(events, days, start, how)


def scan_as_of(
    events: DataFrame, prices: DataFrame, keep: list[str], key: str = "ticker", moment: str = "ts", name: str = "as-of"
) -> DataFrame:
    """Attach to each event the first price row of its key at or after its moment, as
    ``start_<moment>`` and the price columns in ``keep``; nulls where there is none.

    For moments of any resolution, where a calendar would be too long. Events and prices are
    ordered together by key and moment and cut into ranges. A backward scan of a range carries
    the next price along; where a range has none left, that of the ranges after it is taken, from
    one row per key and range. Events of one key, or one moment, may fill any number of ranges.
    """
    price = F.struct(F.col(moment).alias(f"start_{moment}"), *keep)
    kind = prices.select(price.alias("price")).schema["price"].dataType
    asked = events.select(
        F.col(key).alias("_key"), F.col(moment).alias("_at"), F.lit(0).alias("_order"), F.struct("*").alias("_event"), F.lit(None).cast(kind).alias("_price")
    )
    given = prices.select(
        F.col(key).alias("_key"), F.col(moment).alias("_at"), F.lit(1).alias("_order"),
        F.lit(None).cast(asked.schema["_event"].dataType).alias("_event"), price.alias("_price"),
    )
    salted = asked.unionByName(given).withColumn("_salt", F.xxhash64("_event"))
    both = materialise(salted.repartitionByRange("_key", "_at", "_order", "_salt").withColumn("_slice", F.spark_partition_id()), name)
    backward = Window.partitionBy("_key", "_slice").orderBy(F.desc("_at"), F.desc("_order"))
    carried = F.last("_price", ignorenulls=True).over(backward.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # One row per key and range, the first price of each.
    heads = both.groupBy("_key", "_slice").agg(F.min_by("_price", F.when(F.col("_price").isNotNull(), F.col("_at"))).alias("_head"))
    later = Window.partitionBy("_key").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_next", F.last("_head", ignorenulls=True).over(later)).select("_key", "_slice", "_next")
    scanned = both.withColumn("_found", carried).filter("_order = 0").join(heads, ["_key", "_slice"], "left")
    return scanned.withColumn("_found", F.coalesce("_found", "_next")).select("_event.*", "_found.*")


def join_abnormal(
    events: DataFrame, panel: DataFrame, benchmark: DataFrame, horizons: list[int], how: str = "inner"
) -> DataFrame:
    """Attach ``ret_<h>`` less the benchmark's return, null where either is null.

    Ticker and benchmark each start at their own first row on or after the event date. Both
    calendars are keyed by day, so they are combined before the events are joined once.
    """
    start = panel_start(panel, benchmark)
    bench = calendar(benchmark, start).select(
        "as_of_day", *[F.col(f"ret_{h}").alias(f"_bench_{h}") for h in horizons]
    )
    days = (
        calendar(panel, start)
        .join(bench, "as_of_day")
        .select(
            "ticker",
            "as_of_day",
            "start_date",
            *[(F.col(f"ret_{h}") - F.col(f"_bench_{h}")).alias(f"ret_{h}") for h in horizons],
        )
    )
    return join_calendar(events, days, start, how)


def unpivot_horizons(df: DataFrame, horizons: list[int], keep: list[str]) -> DataFrame:
    """Long form: one row per horizon with a known return."""
    cells = F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"ret_{h}").alias("ret")) for h in horizons])
    return (
        df.select(*keep, F.explode(cells).alias("_cell"))
        .select(*keep, "_cell.horizon", "_cell.ret")
        .filter(F.col("ret").isNotNull())
    )
