"""The ledger of trades, evaluations and backtests: validation, appending and listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark.functions.text import ledger_id


def is_json_object(text: Column) -> Column:
    """Whether a text is a JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))


def with_trade_fields(trades: DataFrame) -> DataFrame:
    """Normalised symbol, side and notional, and ``reject_reason`` (null for a valid trade)."""
    side = F.lower("side")
    reason = (
        F.when(~side.isin(fixed.TRADE_SIDES) | side.isNull(), fixed.BAD_SIDE)
        .when(~(F.col("quantity") > 0) | F.col("quantity").isNull(), fixed.BAD_QUANTITY)
        .when(~(F.col("price") >= 0) | F.col("price").isNull(), fixed.BAD_PRICE)
    )
    return trades.withColumns(
        {
            "kind": F.lit("trade"),
            "reject_reason": reason,
            "notional": F.col("quantity") * F.col("price"),
            "symbol": F.upper("symbol"),
            "side": side,
        }
    )


def with_eval_fields(evals: DataFrame) -> DataFrame:
    """Evaluations need a known status; missing metrics count as an empty object."""
    status = F.lower("status")
    reason = F.when(
        ~status.isin(fixed.EVAL_STATUSES) | status.isNull(), fixed.BAD_STATUS
    ).when(~is_json_object(F.coalesce("metrics", F.lit("{}"))), fixed.BAD_METRICS)
    return evals.withColumns({"kind": F.lit("eval"), "reject_reason": reason, "status": status})


def with_backtest_fields(backtests: DataFrame) -> DataFrame:
    """Backtests need a metrics object with at least one entry."""
    size = F.size(F.map_keys(F.try_variant_get(F.try_parse_json("metrics"), "$", "map<string,variant>")))
    reason = F.when(~is_json_object(F.col("metrics")), fixed.BAD_METRICS).when(
        size == 0, fixed.EMPTY_METRICS
    )
    return backtests.withColumns({"kind": F.lit("backtest"), "reject_reason": reason})


def with_collection(records: DataFrame) -> DataFrame:
    """``kind`` of the named collection; an unknown collection is rejected."""
    kind = F.lit(None).cast("string")
    for name, value in fixed.COLLECTIONS.items():
        kind = F.when(F.col("collection") == name, value).otherwise(kind)
    reason = F.when(kind.isNull(), F.concat(F.lit(fixed.UNKNOWN_COLLECTION), F.col("collection")))
    return records.withColumns({"kind": kind, "reject_reason": reason})


def accepted(checked: DataFrame, id_columns: list[str]) -> DataFrame:
    """Valid records with their ids."""
    return (
        checked.filter("reject_reason IS NULL")
        .drop("reject_reason")
        .withColumn("record_id", ledger_id(*id_columns))
    )


def rejected(checked: DataFrame) -> DataFrame:
    return checked.filter("reject_reason IS NOT NULL")


def append_ledger(records: DataFrame, path: str) -> None:
    """Append valid records, one folder per kind."""
    records.write.mode("append").partitionBy("kind").json(path)


def newest_first(records: DataFrame, limit: int | None = fixed.LEDGER_LIST_LIMIT) -> DataFrame:
    """Latest records first; ``seq`` decides between records of the same moment."""
    ordered = records.orderBy(F.desc("created_at"), F.desc("seq"))
    return ordered if limit is None else ordered.limit(limit)
