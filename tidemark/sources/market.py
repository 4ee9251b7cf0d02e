"""Price files: one parquet per ticker, brought into one long panel."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def named(columns: list[str], wanted: str) -> list[str]:
    """Columns called ``wanted``, also as the first level of a flattened two-level name."""
    pattern = re.compile(rf"^\(?'?{re.escape(wanted)}'?(,.*)?\)?$")
    return [c for c in columns if pattern.match(c)]


def read_market(
    spark: SparkSession, folder: str, date_column: str = "Date", tickers: list[str] | None = None
) -> DataFrame:
    """``ticker, date, close`` from files named after their ticker; ``tickers`` keeps other files
    from being opened.

    Files are read whole, each by one task and with its own schema, in one pass: a file with adjusted
    closes uses those, any other its closes; rows without a price are left out. A file of prices is
    as long as the calendar. Times may have been written in any unit.
    """
    pattern = "*.parquet" if tickers is None else "{" + ",".join(tickers) + "}.parquet"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    ticker = F.regexp_extract(F.col("path"), r"([^/=]+?)(\.parquet)?(/part-[^/]*)?$", 1)

    def prices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from file_prices(name, pq.ParquetFile(pa.BufferReader(content.as_buffer())).read(), date_column)

    return files.load(folder).select(ticker.alias("ticker"), "content").mapInArrow(prices, "ticker string, date date, close double")


def file_prices(ticker: str, table: pa.Table, date_column: str) -> Iterator[pa.RecordBatch]:
    """The prices of one file."""
    days = table.column(date_column).cast(pa.timestamp("us"), safe=False).cast(pa.date32(), safe=False)
    found = None
    for wanted in ("Adj Close", "Close"):
        columns = [table.column(c).cast(pa.float64()) for c in named(table.column_names, wanted)]
        priced = pc.coalesce(*columns) if columns else None
        if priced is not None and priced.null_count < len(priced):
            found = priced
            break
    if found is None:
        return
    names = pa.array([ticker] * len(days), pa.string())
    rows = pa.table({"ticker": names, "date": days, "close": found})
    yield from rows.filter(pc.is_valid(rows.column("close"))).combine_chunks().to_batches()


def for_display(prices: DataFrame) -> DataFrame:
    return prices.withColumn("close", F.round("close", 2))


def price_range(prices: DataFrame, ticker: str, start=None, end=None) -> DataFrame:
    """Prices of a ticker between two dates, each bound optional; no match gives no rows."""
    out = prices.filter(F.col("ticker") == ticker)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out
