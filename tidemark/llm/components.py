"""Connected components of a graph of any size, with components of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written


#: Edges that one task takes. The tables of a round get as many partitions as that asks for.
EDGES_PER_TASK = 250_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the least node of its component) for every node with an edge.

    Alternating star contraction: each node's larger neighbours, then its smaller ones, are hung
    on the least node it knows, until nothing moves. A round is one written table, and only a
    count and a checksum reach the driver.
    """
    tree = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u != v")
    tree = written(tree.distinct(), "edges")
    state = checksum(tree)
    while state[0]:
        rows = state[0]
        tree = written(small_star(large_star(sized(tree, rows), rows), rows), "edges")
        before, state = state, checksum(tree)
        if state == before:
            break
    tree = sized(tree, state[0])
    ends = F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("root")), F.struct(F.col("v").alias("node"), F.col("v").alias("root")))
    return tree.select(F.inline(ends)).distinct()


def sized(tree: DataFrame, rows: int) -> DataFrame:
    return tree.coalesce(math.ceil(max(rows, 1) / EDGES_PER_TASK))


def checksum(tree: DataFrame) -> tuple:
    return tuple(tree.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_neighbours(tree: DataFrame, rows: int) -> DataFrame:
    """``node`` and ``least``: the least smaller neighbour of each node that has one. In a graph of
    many tasks it is a written table, so that a hub is a skewed key of a plain join, which Spark
    can split."""
    found = tree.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("least"))
    return written(found, "least") if rows > EDGES_PER_TASK else found


def large_star(tree: DataFrame, rows: int) -> DataFrame:
    known = tree.join(least_neighbours(tree, rows), F.col("v") == F.col("node"), "left")
    return known.select("u", F.coalesce("least", "v").alias("v"))


def small_star(tree: DataFrame, rows: int) -> DataFrame:
    known = tree.join(least_neighbours(tree, rows), F.col("u") == F.col("node"))
    ways = F.array(F.struct("u", F.col("least").alias("v")), F.struct(F.col("v").alias("u"), F.col("least").alias("v")))
    return known.select(F.inline(ways)).filter("u != v").distinct()
