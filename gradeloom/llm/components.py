"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import Scratch


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` (u, v as bigint) to one row per node: node, root (the smallest node it reaches).

    Each round hangs a node's larger neighbours under its smallest one, then its smaller ones;
    the minimum per node is combined on the map side, and its join back has one row per node, so
    a hub is split like any skewed key. Every round's edges are written, so a lost executor
    costs a task's retry. The number of rounds grows with the logarithm of the longest path.
    """
    edges = scratch.write(edges.where("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = _mark(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            "u", F.least("u", "m").alias("m"))
        large = scratch.write(both.where("v > u").join(least, "u").where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # A node's smaller neighbours and the node itself all hang under the smallest of them.
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = scratch.write(small.where("u != v").distinct(), "small")
        scratch.drop(large)
        scratch.drop(edges)
        edges, mark = after, _mark(after)
        if mark == before:
            break
        before = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
