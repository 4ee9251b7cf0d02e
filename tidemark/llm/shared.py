"""Helpers that several corpus operators use."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import let
from tidemark.session import scratch_path


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below ``spark.checkpoint.dir``, which driver and executors share."""
    return scratch_path(spark, name)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends here, so an executor that
    is lost later costs no recomputation, and the table has a known size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that no other column of the
    input can clash: ``columns_of(df, id="doc_id", text="text")``."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in wanted.items()])


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until it is no column of ``df``, however columns are spelt."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose id is in the one column of ``gone``; all columns as they were,
    whatever they are called."""
    key = unused(df, "gone")
    return df.join(gone.toDF(key), df[f"`{id_col}`"].eqNullSafe(F.col(key)), "left_anti")


def map_rows(
    df: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str
) -> DataFrame:
    """``rows`` over the tuples of each partition, batch by batch; what it yields has ``schema``.

    Only one Arrow batch of input is in memory at a time, and output is cut into batches by rows
    and by size, so a few very long texts do not pile up.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tuples():
            for batch in batches:
                yield from zip(*[column.to_pylist() for column in batch.columns])

        out, weight = [], 0
        for row in rows(tuples()):
            out.append(row)
            weight += sum(len(v) for v in row if hasattr(v, "__len__")) + 64
            if weight > 8 << 20:
                yield packed(out, arrow)
                out, weight = [], 0
        if out:
            yield packed(out, arrow)

    return df.mapInArrow(run, fields)


def map_arrays(df: DataFrame, arrays: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Like :func:`map_rows` for many small rows: ``arrays`` yields a tuple of numpy or Arrow arrays,
    one per column, for as many rows at a time as it likes."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = to_arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tuples = (row for batch in batches for row in zip(*[column.to_pylist() for column in batch.columns]))
        for columns in arrays(tuples):
            made = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, arrow)]
            yield pa.RecordBatch.from_arrays(made, schema=arrow)

    return df.mapInArrow(run, fields)


def to_arrow(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def packed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)], schema=schema
    )


def running_sums(values: Column) -> Column:
    """Running sums of an array of numbers, in blocks, so that long arrays stay cheap."""
    block = 256

    def sums(part: Column) -> Column:
        return F.aggregate(
            part,
            F.array().cast("array<long>"),
            lambda done, x: F.concat(
                done, F.array(F.coalesce(F.get(done, F.size(done) - 1), F.lit(0)) + x)
            ),
        )

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda done, x: done + x)

    def shifted(parts: Column, ends: Column) -> Column:
        return F.flatten(
            F.transform(
                parts,
                lambda part, i: let(
                    F.coalesce(F.get(ends, i - 1), F.lit(0)),
                    lambda base: F.transform(sums(part), lambda x: x + base),
                ),
            )
        )

    def cut(longs: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.floor((F.size(longs) - 1) / block).cast("int")),
            lambda i: F.slice(longs, i * block + 1, block),
        )

    def filled(longs: Column) -> Column:
        summed = let(
            cut(longs), lambda parts: let(sums(F.transform(parts, total)), lambda ends: shifted(parts, ends))
        )
        return F.when(F.size(longs) == 0, F.array().cast("array<long>")).otherwise(summed)

    return let(F.transform(values, lambda x: x.cast("long")), filled)
