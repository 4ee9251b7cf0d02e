"""Helpers that keep a costly expression from being computed more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row. As a generated column it is neither copied
    into filters below it nor merged into later projections."""
    kept = [c for c in df.columns if c != name]
    return df.select(*kept, F.explode(F.array(value)).alias(name))
