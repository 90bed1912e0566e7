"""Nearest neighbours of large collections: an exact pivot tree and a hashed index.

The caller picks one; neither looks at the number of rows to change its results.

``tree_nearest`` is exact. Rows are cut into cells around some pivots and each cell into leaves
around pivots of its own, so leaves stay near ``leaf_rows`` and their number grows with the data. A
query first searches the leaf it falls into, which bounds its k-th distance, and then visits those
cells and leaves alone that reach inside that bound. Pivots of leaves are a table that meets the rows
of its cell in blocks; no task holds a cell, and no row carries more than one leaf's answer.

``hashed_nearest`` is approximate: rows and queries meet where one of ``tables`` keys is equal, a key
being the buckets of ``width`` random projections.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from math import isqrt
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.constants import NEIGHBOURS
from gradeloom.operators import neighbours as nb
from gradeloom.operators.ranking import top_per_group
from gradeloom.sources.staging import settle, stage

# Ship the functions below with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Top pivots are sent to every task; beyond that many the cells hold more leaves instead.
MAX_TOPS = 512
LEAST_LEAF = 64
ROUTE_ROWS = 4096
# Hashed index: keys, projections of a key, width of a bucket in typical k-th distances.
TABLES = 10
WIDTH = 4
REACH = 4.0
SAMPLE = 2048

TREE = ["part", "cell", "leaf"]


class PivotTree(NamedTuple):
    """Rows with their leaf, leaves and cells with size and radius, and the top pivots."""

    rows: DataFrame
    leaves: DataFrame
    cells: DataFrame
    centres: np.ndarray


def _meet(left: DataFrame, right: DataFrame, keys: Sequence[str], by: str,
          run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``run`` on blocks of ``left`` and all rows of ``right`` with the same keys.

    ``right`` has few rows per key; it is repeated for every block.
    """
    blocks = settle(left.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / ROUTE_ROWS).cast("int").alias("_blocks")), "blocks")
    ours = left.join(blocks, [*keys], "left").withColumn(
        "_block", F.pmod(F.xxhash64(by), F.col("_blocks")).cast("int")).drop("_blocks")
    theirs = right.join(blocks, [*keys]).withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return run(a, b) if len(a) and len(b) else pd.DataFrame(columns=names)

    names = [part.split()[0] for part in schema.split(", ")]
    return ours.groupBy(*keys, "_block").cogroup(theirs.groupBy(*keys, "_block")).applyInPandas(
        both, schema)


def _distances(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
    return np.sqrt(nb._squared(nb._matrix(left["features"]), nb._matrix(right["features"])))


def _to_leaf(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    pivots = pivots.sort_values("leaf")
    far = _distances(rows, pivots)
    nearest = far.argmin(axis=1)
    return rows.drop(columns=["_block"]).assign(
        leaf=pivots["leaf"].to_numpy()[nearest], reach=far[np.arange(len(rows)), nearest])


def _least_distance(far: np.ndarray, pivots: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """How near a row of each pivot's side can be to a query, from the distances to the pivots.

    A row is within its pivot's radius, and no nearer to the pivot that is nearest to the query: it
    lies beyond the plane halfway between the two.
    """
    near = far.argmin(axis=1)
    used, back = np.unique(near, return_inverse=True)
    gap = np.sqrt(nb._squared(pivots[used], pivots))[back]
    ahead = far ** 2 - far[np.arange(len(far)), near][:, None] ** 2
    plane = np.divide(ahead, 2 * gap, out=np.zeros_like(far), where=gap > 0)
    return np.maximum(far - radius, plane)


def _within(far: np.ndarray, right: pd.DataFrame, bound: np.ndarray,
            k: int) -> np.ndarray:
    """Bounds of the k-th distance from the sizes and radii of ``right``, if not better known."""
    size, radius = right["size"].to_numpy(), right["radius"].to_numpy()
    reach = far + radius
    order = np.argsort(reach, axis=1)
    enough = (np.cumsum(size[order], axis=1) < k).sum(axis=1)
    known = np.take_along_axis(reach, order, axis=1)
    last = np.minimum(enough, known.shape[1] - 1)
    own = np.where(enough < known.shape[1], known[np.arange(len(known)), last], np.inf)
    return np.fmin(bound, own)


def build_tree(train: DataFrame, k: int = NEIGHBOURS, leaf_rows: int | None = None) -> PivotTree:
    """A tree over ``part, id, features``. Of copies of one vector the k smallest ids are kept.

    ``leaf_rows`` is the aimed size of a leaf; by default the square root of the rows.
    """
    features = F.transform("features", lambda x: x.cast("double")).alias("features")
    rows = train.select("part", F.col("id").alias("neighbour"), features)
    rows = stage(top_per_group(rows, ["part", "features"], [F.col("neighbour")], k,
                               spread_by="neighbour").drop("rank"), "train")
    count = rows.count()
    leaf_rows = leaf_rows or max(LEAST_LEAF, isqrt(count))
    tops = min(MAX_TOPS, isqrt(count // leaf_rows) + 1)
    # At most MAX_TOPS rows reach the driver; they only steer the pruning.
    chosen = rows.select("neighbour", "features").orderBy(
        F.xxhash64("neighbour"), "neighbour").limit(tops).collect()
    centres = np.array([r["features"] for r in chosen], np.float64)
    located = stage(rows.mapInPandas(nb._assign(centres), "part string, neighbour bigint, "
                                     "features array<double>, cell int, radius double"), "located")
    # One row in leaf_rows by hash, and the row nearest to the centre, so no cell is without.
    picked = located.where(F.pmod(F.xxhash64("neighbour", F.lit(1)), F.lit(leaf_rows)) == 0).select(
        "part", "cell", F.col("neighbour").alias("leaf"), "features")
    middle = located.groupBy("part", "cell").agg(
        F.min_by(F.struct("neighbour", "features"), F.struct("radius", "neighbour")).alias("m")).select(
        "part", "cell", F.col("m.neighbour").alias("leaf"), F.col("m.features").alias("features"))
    pivots = stage(picked.union(middle).dropDuplicates(TREE), "pivots")
    placed = stage(_meet(
        located, pivots, ["part", "cell"], "neighbour", _to_leaf,
        "part string, neighbour bigint, features array<double>, cell int, radius double, "
        "leaf bigint, reach double"), "tree")
    sizes = placed.groupBy(*TREE).agg(F.count(F.lit(1)).alias("size"), F.max("reach").alias("radius"))
    leaves = stage(pivots.join(sizes, TREE), "leaves")
    cells = stage(placed.groupBy("part", "cell").agg(
        F.count(F.lit(1)).alias("size"), F.max("radius").alias("radius")), "tops")
    return PivotTree(placed.select(*TREE, "neighbour", "features"), leaves, cells, centres)


def _search(asked: DataFrame, held: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """``query, neighbour, d2``: the k nearest of each block of ``held`` with the query's keys."""
    loads = asked.groupBy(*keys).agg(F.count(F.lit(1)).alias("asked")).join(
        held.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")), [*keys])
    return nb.block_search(asked, held, loads, keys, k)


def _asked(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The queries, and one row for each of their different vectors."""
    features = F.transform("features", lambda x: x.cast("double")).alias("features")
    rows = settle(queries.select("part", F.col("id").alias("query"), features), "queries")
    return rows, stage(rows.groupBy("part", "features").agg(F.min("query").alias("query")), "asked")


def _answers(rows: DataFrame, asked: DataFrame, best: DataFrame) -> DataFrame:
    searched = asked.select("part", "features", F.col("query").alias("_asked"))
    return rows.join(searched, ["part", "features"]).select("query", "_asked").join(
        best.withColumnRenamed("query", "_asked"), "_asked").select("query", "neighbour", "d2", "rank")


def first_leaves(tree: PivotTree, asked: DataFrame) -> DataFrame:
    """``part, query, features, cell, leaf``: the leaf that each query falls into."""
    centres = tree.centres

    def nearest_cell(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cell = cells["cell"].sort_values().to_numpy()
        far = nb._squared(nb._matrix(rows["features"]), centres[cell])
        return rows.drop(columns=["_block"]).assign(cell=cell[far.argmin(axis=1)])

    home = stage(_meet(asked, tree.cells, ["part"], "query", nearest_cell,
                       "part string, features array<double>, query bigint, cell int"), "home")
    return stage(_meet(home, tree.leaves, ["part", "cell"], "query", _to_leaf,
                       "part string, features array<double>, query bigint, cell int, leaf bigint, "
                       "reach double").select(*TREE, "query", "features"), "first")


def later_leaves(tree: PivotTree, first: DataFrame, bounds: DataFrame, k: int) -> DataFrame:
    """``part, cell, leaf, query, features``: the other leaves that reach inside the bounds."""
    centres = tree.centres

    def cells_in_reach(rows: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        cell = cells["cell"].to_numpy()
        far = np.sqrt(nb._squared(nb._matrix(rows["features"]), centres))
        # Rows were dealt over all centres, so any of them gives a plane.
        radius = np.full(len(centres), -np.inf)
        radius[cell] = cells["radius"].to_numpy()
        least = _least_distance(far, centres, radius)[:, cell]
        bound = _within(far[:, cell], cells, rows["bound"].to_numpy(np.float64), k)
        at, to = np.nonzero(least <= (bound * (1 + nb.SLACK) + nb.SLACK)[:, None])
        out = rows.drop(columns=["_block"]).assign(bound=bound).iloc[at]
        return out.assign(cell=cell[to])

    def leaves_in_reach(rows: pd.DataFrame, leaves: pd.DataFrame) -> pd.DataFrame:
        far = _distances(rows, leaves)
        near = _least_distance(far, nb._matrix(leaves["features"]), leaves["radius"].to_numpy()) <= (
            rows["bound"].to_numpy() * (1 + nb.SLACK) + nb.SLACK)[:, None]
        leaf = leaves["leaf"].to_numpy()
        near &= (rows["home"].to_numpy()[:, None] != leaf) | (
            rows["home_cell"].to_numpy() != rows["cell"].to_numpy())[:, None]
        at, to = np.nonzero(near)
        return rows[["part", "cell", "query", "features"]].iloc[at].assign(leaf=leaf[to])

    bounded = first.select("part", "query", "features", F.col("cell").alias("home_cell"),
                           F.col("leaf").alias("home")).join(bounds, "query", "left")
    routed = stage(_meet(
        bounded, tree.cells, ["part"], "query", cells_in_reach,
        "query bigint, part string, features array<double>, home_cell int, home bigint, "
        "bound double, cell int"), "cells-in-reach")
    return stage(_meet(routed, tree.leaves, ["part", "cell"], "query", leaves_in_reach,
                       "part string, cell int, query bigint, features array<double>, leaf bigint"),
                 "leaves-in-reach").select(*TREE, "query", "features")


def pairs_visited(tree: PivotTree, *visits: DataFrame) -> int:
    """Pairs of a query and a row whose distance the visits compute."""
    return sum(v.groupBy(*TREE).agg(F.count(F.lit(1)).alias("n")).join(tree.leaves, TREE).agg(
        F.sum(F.col("n") * F.col("size"))).first()[0] or 0 for v in visits)


def tree_nearest(queries: DataFrame, train: DataFrame, k: int = NEIGHBOURS,
                 leaf_rows: int | None = None, tree: PivotTree | None = None,
                 count_pairs: Callable[[int], None] | None = None) -> DataFrame:
    """``query, neighbour, d2, rank``: exact, ties to the smaller id; see ``neighbours.nearest``.

    A ``tree`` built before serves any number of query sets (with k no larger than it was built
    for). ``count_pairs`` is told how many pairs were compared.
    """
    tree = tree or build_tree(train, k, leaf_rows)
    rows, asked = _asked(queries)
    first = first_leaves(tree, asked)
    near = stage(_search(first, tree.rows, TREE, k), "near")
    kth = top_per_group(near, ["query"], [F.col("d2"), F.col("neighbour")], k).groupBy("query").agg(
        F.max("rank").alias("found"), F.sqrt(F.max("d2")).alias("far"))
    bounds = kth.select("query", F.when(F.col("found") >= k, F.col("far")).alias("bound"))
    later = later_leaves(tree, first, bounds, k)
    if count_pairs:
        count_pairs(pairs_visited(tree, first, later))
    both = near.union(_search(later, tree.rows, TREE, k))
    return _answers(rows, asked, top_per_group(both, ["query"], [F.col("d2"), F.col("neighbour")], k))


def typical_distance(train: DataFrame, k: int = NEIGHBOURS) -> float:
    """Median distance to the k-th nearest inside a sample of at most ``SAMPLE`` rows.

    The sample is thinner than the data, so the figure errs towards wide buckets, which cost work
    and not recall.
    """
    chosen = train.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("part", "features").toPandas()
    found = []
    for _, part in chosen.groupby("part"):
        points = nb._matrix(part["features"])
        if len(points) > 1:
            d2 = np.sort(nb._squared(points, points), axis=1)
            found.append(np.sqrt(d2[:, min(k, len(points) - 1)]))
    return float(np.median(np.concatenate(found))) if found else 1.0


def hashed_nearest(queries: DataFrame, train: DataFrame, k: int = NEIGHBOURS, tables: int = TABLES,
                   width: int = WIDTH, bucket: float | None = None, seed: int = 7) -> DataFrame:
    """``query, neighbour, d2, rank`` among the rows that share a key with the query.

    ``bucket`` is the length of a bucket along a projection, by default from ``typical_distance``. Every
    row is indexed. More tables raise the recall, more projections lower the work; crowded keys are
    searched in blocks. Queries that meet fewer than k rows get fewer.
    """
    size = train.select(F.size("features")).first()
    if size is None:
        return queries.sparkSession.createDataFrame(
            [], "query bigint, neighbour bigint, d2 double, rank int")
    size = size[0]
    rng = np.random.default_rng(seed)
    lines = rng.normal(size=(size, tables * width))
    lines /= np.linalg.norm(lines, axis=0)
    step = bucket or max(REACH * typical_distance(train, k) / np.sqrt(size), 1e-12)
    starts = rng.uniform(0, step, tables * width)

    def project(batches):
        for b in batches:
            if len(b):
                at = np.floor((nb._matrix(b["features"]) @ lines + starts) / step).astype(np.int64)
                yield b.assign(buckets=list(at))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        schema = f"part string, features array<double>, {name} bigint, buckets array<bigint>"
        key = F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables - 1)), lambda t: F.struct(
            t.alias("table"), F.xxhash64(F.slice("buckets", t * width + 1, F.lit(width))).alias("key"))))
        return stage(rows.select("part", "features", name).mapInPandas(project, schema).select(
            "part", "features", name, key.alias("k")).select(
            "part", "k.table", "k.key", name, "features"), "keyed")

    rows, asked = _asked(queries)
    features = F.transform("features", lambda x: x.cast("double")).alias("features")
    held = train.select("part", F.col("id").alias("neighbour"), features)
    found = _search(keyed(asked, "query"), keyed(held, "neighbour"), ["part", "table", "key"], k)
    # A pair that meets under several keys counts once.
    once = found.groupBy("query", "neighbour").agg(F.min("d2").alias("d2"))
    return _answers(rows, asked, top_per_group(once, ["query"], [F.col("d2"), F.col("neighbour")], k))


def recall(exact: DataFrame, found: DataFrame) -> DataFrame:
    """``neighbours, found, recall``: the share of the exact neighbours that were found."""
    hits = exact.select("query", "neighbour").join(
        found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("found")).withColumn(
        "recall", F.try_divide(F.col("found"), F.col("neighbours")))
