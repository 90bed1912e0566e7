"""Exact k nearest neighbours as a pruned, blocked join.

Training rows are cut into cells around a fixed number of pivots. A query's k-th distance is
bounded from the cells' sizes and radii, and by the triangle inequality it only visits cells
that can hold something closer. Cells side by side share a shelf, shelves are split into blocks, so no
task holds a whole shelf, and a block gives at most k rows per query: pairs are compared in arrays and
never become rows. Copies of one vector count once: only its k smallest ids can be neighbours.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from gradeloom.functions.constants import NEIGHBOURS
from gradeloom.operators.ranking import top_per_group
from gradeloom.sources.staging import settle, stage

# Ship the functions below with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

PIVOTS = 256
BLOCK_ROWS = 1024
# Rows that meet in one task: a block of queries and a block of training rows.
QUERY_ROWS = 4096
TRAIN_ROWS = 8192
# Distances held at once, and the columns that give a first bound.
HELD = 1 << 21
PROBE = 1024
# Queries routed at once.
ROUTE_ROWS = 1024
# Slack for rounding in pruning distances; it can only widen the search.
SLACK = 1e-9


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64)


def _squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Pairwise squared distances, summed in dimension order as SQL would sum them."""
    out = np.zeros((len(left), len(right)))
    for j in range(left.shape[1]):
        step = left[:, j, None] - right[None, :, j]
        out += step * step
    return out


def _assign(pivots: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                far = np.sqrt(_squared(_matrix(batch["features"]), pivots))
                cell = far.argmin(axis=1)
                yield batch.assign(cell=cell, radius=far[np.arange(len(cell)), cell])
    return run


def _in_line(centres: np.ndarray) -> np.ndarray:
    """Centres along their widest direction, so that cells side by side are near each other."""
    if not np.isfinite(centres).all():
        return centres
    off = centres - centres.mean(axis=0)
    return centres[np.argsort(off @ np.linalg.svd(off, full_matrices=False)[2][0], kind="stable")]


def _route(pivots: np.ndarray, k: int):
    """Shelves each query must visit, given its group's cells as arrays."""
    def shelves_of(far: np.ndarray, cells: np.ndarray, sizes: np.ndarray, radii: np.ndarray,
                   shelves: np.ndarray) -> list[np.ndarray]:
        to_pivot = far[:, cells]
        reach = to_pivot + radii
        order = np.argsort(reach, axis=1)
        enough = (np.cumsum(sizes[order], axis=1) < k).sum(axis=1)
        last = np.minimum(enough, len(cells) - 1)
        bound = np.where(enough < len(cells), np.take_along_axis(
            reach, order, axis=1)[np.arange(len(far)), last], np.inf)
        # Distances that are no numbers rule nothing out.
        visited = ~(to_pivot - radii > (bound * (1 + SLACK) + SLACK)[:, None])
        return [np.unique(shelves[row]) for row in visited]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # Rows of one group share their cells.
            for at in batch.groupby("part").indices.values():
                known = [np.asarray(batch[c].iloc[at[0]]) for c in (
                    "cells", "sizes", "radii", "shelves")]
                for start in range(0, len(at), ROUTE_ROWS):
                    rows = batch[["part", "query", "features"]].iloc[at[start:start + ROUTE_ROWS]]
                    far = np.sqrt(_squared(_matrix(rows["features"]), pivots))
                    yield rows.assign(shelves=shelves_of(far, *known))
    return run


def _k_nearest(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Row of ``left``, row of ``right`` and squared distance of the k nearest, ties to earlier rows.

    A matrix product gives distances up to rounding; pairs that may be among the k nearest by a bound
    of that rounding are computed again, summed in dimension order as SQL would sum them.
    """
    k = min(k, len(right))
    own, other = (left * left).sum(axis=1), (right * right).sum(axis=1)
    rounding = 8 * (left.shape[1] + 8) * np.finfo(np.float64).eps
    found = []
    rows = max(1, HELD // len(right))
    for start in range(0, len(left), rows):
        part = left[start:start + rows]
        rough = part @ right.T
        rough *= -2.0
        rough += own[start:start + rows, None]
        rough += other
        slack = rounding * (own[start:start + rows] + other.max())
        if np.isfinite(rough).all():
            bound = np.partition(rough[:, :max(PROBE, k)], k - 1, axis=1)[:, k - 1]
            near = rough <= (bound + 2 * slack)[:, None]
            if near.sum() > PROBE * len(part):
                bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
                near = rough <= (bound + 2 * slack)[:, None]
            at, to = np.nonzero(near)
        else:
            at, to = (side.ravel() for side in np.indices(rough.shape))
        d2 = np.zeros(len(at))
        for j in range(part.shape[1]):
            step = part[at, j] - right[to, j]
            d2 += step * step
        order = np.lexsort((to, d2, at))
        at, to, d2 = at[order], to[order], d2[order]
        first = np.arange(len(at)) - np.searchsorted(at, at) < k
        found.append((at[first] + start, to[first], d2[first]))
    return tuple(np.concatenate(side) for side in zip(*found))


def _block_top(k: int):
    def run(queries: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(train):
            return pd.DataFrame({"query": [], "neighbour": [], "d2": []}).astype(
                {"query": "int64", "neighbour": "int64", "d2": "float64"})
        train = train.sort_values("neighbour")
        at, to, d2 = _k_nearest(_matrix(queries["features"]), _matrix(train["features"]), k)
        return pd.DataFrame({"query": queries["query"].to_numpy()[at],
                             "neighbour": train["neighbour"].to_numpy()[to], "d2": d2})
    return run


def _blocks(size: str, rows: int):
    return F.greatest(F.ceil(F.col(size) / F.lit(rows)), F.lit(1)).cast("int")


def block_search(asked: DataFrame, held: DataFrame, loads: DataFrame, keys: Sequence[str],
                 k: int) -> DataFrame:
    """``query, neighbour, d2``: the k nearest of each block of ``held`` with the query's keys.

    ``loads`` has the keys with ``asked`` queries and ``size`` rows, both positive.
    """
    loads = settle(loads.select(*keys, _blocks("size", TRAIN_ROWS).alias("train_blocks"),
                                _blocks("asked", QUERY_ROWS).alias("query_blocks")), "loads")

    def every(count: str):
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    def own(id_column: str, count: str):
        return F.pmod(F.xxhash64(id_column), F.col(count)).cast("int")

    block = [*keys, "train_block", "query_block"]
    left = asked.join(loads, [*keys], "left").where("train_blocks IS NOT NULL").withColumn(
        "query_block", own("query", "query_blocks")).withColumn(
        "train_block", every("train_blocks")).select(*block, "query", "features")
    right = held.join(loads, [*keys], "left").where("query_blocks IS NOT NULL").withColumn(
        "train_block", own("neighbour", "train_blocks")).withColumn(
        "query_block", every("query_blocks")).select(*block, "neighbour", "features")
    return left.groupBy(*block).cogroup(right.groupBy(*block)).applyInPandas(
        _block_top(k), "query bigint, neighbour bigint, d2 double")


def nearest(queries: DataFrame, train: DataFrame, k: int = NEIGHBOURS,
            pivots: int | None = None) -> DataFrame:
    """``query, neighbour, d2, rank`` of the k nearest training rows in the query's group.

    Both inputs have ``part`` (group key), ``id`` and ``features`` (array of double).
    """
    session = train.sparkSession
    features = F.transform("features", lambda x: x.cast("double")).alias("features")
    queries = settle(queries.select("part", F.col("id").alias("query"), features), "queries")
    train = train.select("part", F.col("id").alias("neighbour"), features)
    train = stage(top_per_group(train, ["part", "features"], [F.col("neighbour")], k,
                                spread_by="neighbour").drop("rank"), "train")

    if pivots is None:
        pivots = min(PIVOTS, max(1, train.count() // BLOCK_ROWS))
    # At most `pivots` rows reach the driver; they only steer the pruning.
    chosen = train.select("neighbour", "features").orderBy(
        F.xxhash64("neighbour"), "neighbour").limit(pivots).collect()
    if not chosen:
        return session.createDataFrame(
            [], "query bigint, neighbour bigint, d2 double, rank int")
    centres = _in_line(np.array([row["features"] for row in chosen], dtype=np.float64))

    located = stage(train.mapInPandas(
        _assign(centres), "part string, neighbour bigint, features array<double>, "
        "cell int, radius double"), "cells")
    # One row per group with at most `pivots` cells, which fill shelves in turn.
    before = Window.partitionBy("part").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = settle(located.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("radius").alias("radius")).withColumn(
        "shelf", F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / TRAIN_ROWS).cast("int")),
        "radii")
    maps = cells.groupBy("part").agg(F.sort_array(F.collect_list(
        F.struct("cell", "size", "radius", "shelf"))).alias("m")).select(
        "part", F.col("m.cell").alias("cells"), F.col("m.size").alias("sizes"),
        F.col("m.radius").alias("radii"), F.col("m.shelf").alias("shelves"))

    # Equal query vectors are searched once. The shelves of a query stay in its row.
    asked = queries.groupBy("part", "features").agg(F.min("query").alias("query"))
    routed = stage(asked.join(maps, "part").select(
        "part", "query", "features", "cells", "sizes", "radii", "shelves").mapInPandas(
        _route(centres, k), "part string, query bigint, features array<double>, "
        "shelves array<int>"), "routed")
    key = ["part", "shelf"]
    visits = routed.select("part", F.explode("shelves").alias("shelf")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("asked"))
    loads = visits.join(cells.groupBy(*key).agg(F.sum("size").alias("size")), key)
    partial = block_search(
        routed.select("part", F.explode("shelves").alias("shelf"), "query", "features"),
        located.join(cells.select("part", "cell", "shelf"), ["part", "cell"], "left").select(
            *key, "neighbour", "features"), loads, key, k)
    best = top_per_group(partial, ["query"], [F.col("d2"), F.col("neighbour")], k)

    searched = asked.select("part", "features", F.col("query").alias("_asked"))
    return queries.join(searched, ["part", "features"]).select("query", "_asked").join(
        best.withColumnRenamed("query", "_asked"), "_asked").select(
        "query", "neighbour", "d2", "rank")


def vote(neighbours: DataFrame, labels: DataFrame) -> DataFrame:
    """``query, predicted``: the most frequent label; ties go to the smallest.

    ``labels`` has ``id`` and ``label``. A query brings at most k rows.
    """
    named = neighbours.join(
        labels.select(F.col("id").alias("neighbour"), "label"), "neighbour")
    counts = named.groupBy("query", "label").agg(F.count(F.lit(1)).alias("votes"))
    won = top_per_group(counts, ["query"], [F.desc("votes"), F.asc("label")], 1)
    return won.select("query", F.col("label").alias("predicted"), "votes")
