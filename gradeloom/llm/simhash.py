"""Near-duplicate documents by SimHash and covering locality-sensitive hashing.

A covering family is built from one random map of the 64 bit positions to vectors of
``radius + 1`` bits. Table v (every nonzero vector) keeps the positions whose vector has odd
inner product with v. Two fingerprints that differ in at most ``radius`` positions span too
few vectors to meet every v, so some table keeps none of those positions and both fall into the
same bucket: no pair is lost, whatever the data.

Equal fingerprints are one row from the start, so a group of copies costs nothing. Buckets of
two are compared in the aggregate itself. Larger buckets go to a task that grows spanning trees
(``forest``): each reached fingerprint leaves the search, which emits fewer rows than
members. Buckets beyond ``bucket_limit`` are linked over midpoints (``_by_midpoints``), which
needs a fixed number of rows per fingerprint however large the bucket is.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import Scratch, hidden_id, shown_id
from gradeloom.llm.components import components

SHINGLE_WORDS = 3
MAX_BITS = 3
SEED = 42
BUCKET_LIMIT = 32768
CELLS = 1 << 21


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash as a signed 64-bit integer; texts without words give 0."""
    # bytes.lower changes A-Z only and bytes.split cuts at 0x20 and 0x09-0x0D only.
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CELLS // 64):
        block = hashes[at:at + CELLS // 64].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * bits > len(hashes), bitorder="little")
    return int(on.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp for every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": [
                fingerprint(t, words) for t in b["text"]]})

    return docs.select(shown_id("doc_id"), "text").mapInPandas(
        run, "doc_id bigint, fp bigint").withColumn("doc_id", hidden_id("doc_id"))


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """Masks as signed 64-bit integers; every pattern of ``radius`` bits misses one of them."""
    size = radius + 1
    draw = random.Random(seed)
    # Vectors are dealt evenly, so each table keeps about half of the positions.
    vectors = [1 + i % (2 ** size - 1) for i in range(64)]
    draw.shuffle(vectors)
    masks = []
    for v in range(1, 2 ** size):
        mask = sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return masks


def forest(prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of spanning trees over all pairs of distinct ``prints`` within ``radius``."""
    prints = prints.astype(np.int64).view(np.uint64)
    left, right = [], []
    open_ = np.arange(1, len(prints))
    frontier = np.arange(min(1, len(prints)))
    while len(open_):
        if not len(frontier):
            frontier, open_ = open_[:1], open_[1:]
            continue
        step = max(1, CELLS // max(1, len(open_)))
        some, frontier = frontier[:step], frontier[step:]
        near = np.bitwise_count(prints[some][:, None] ^ prints[open_][None, :]) <= radius
        reached = near.any(axis=0)
        left.append(some[near[:, reached].argmax(axis=0)])
        right.append(open_[reached])
        frontier = np.concatenate([frontier, open_[reached]])
        open_ = open_[~reached]
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    back = prints.view(np.int64)
    return back[np.concatenate(left)], back[np.concatenate(right)]


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _by_midpoints(crowd: DataFrame, radius: int) -> DataFrame:
    """Edges that connect all pairs within ``radius`` (at most 3) of a set of fingerprints.

    Two fingerprints d <= 3 bits apart share a point one bit from one and two from the other.
    At every such point all fingerprints within two bits are tied to the smallest within one
    bit, which is at most three bits away: a star, never all pairs.
    """
    inner = radius // 2
    flips = [0] + [1 << i for i in range(64)]
    double = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in flips + double]
    reach = {0: signed[:1], 1: signed[:65], 2: signed}

    def points(distance: int) -> DataFrame:
        masks = F.array(*(F.lit(x) for x in reach[distance]))
        return crowd.select("fp", F.explode(F.transform(
            masks, lambda m: m.bitwiseXOR(F.col("fp")))).alias("point"))

    centres = points(inner).groupBy("point").agg(F.min("fp").alias("v"))
    return points(radius - inner).join(centres, "point").where("fp != v").select(
        F.col("fp").alias("u"), "v").distinct()


def near_pairs(prints: DataFrame, radius: int, scratch: Scratch,
               bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that join everything within ``radius``."""
    masks = covering_masks(radius)
    keyed = prints.select("fp", F.explode(F.array(*(
        F.struct(F.lit(i).alias("tab"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(masks)))).alias("k")).select("fp", "k.tab", "k.key")
    sizes = keyed.groupBy("tab", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
    sizes = scratch.write(sizes.where("n > 1"), "buckets")
    pairs = sizes.where("n = 2").where(_distance(F.col("u"), F.col("v")) <= radius).select("u", "v")
    crowded = sizes.where(f"n > 2 and n <= {bucket_limit}").select("tab", "key")
    # Whole buckets, at most bucket_limit rows each, one after the other in a task.
    rows = keyed.join(crowded, ["tab", "key"]).repartition("tab", "key").sortWithinPartitions(
        "tab", "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(part: pd.DataFrame) -> pd.DataFrame:
            tab, key = part["tab"].to_numpy(), part["key"].to_numpy()
            fp = part["fp"].to_numpy(np.int64)
            cut = np.flatnonzero((tab[1:] != tab[:-1]) | (key[1:] != key[:-1])) + 1
            found = [forest(x, radius) for x in np.split(fp, cut)]
            return pd.DataFrame({"u": np.concatenate([f[0] for f in found]),
                                 "v": np.concatenate([f[1] for f in found])})

        held: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            last = (b["tab"] == b["tab"].iloc[-1]) & (b["key"] == b["key"].iloc[-1])
            if held and (last.all() and (held[0]["tab"].iloc[-1], held[0]["key"].iloc[-1])
                         == (b["tab"].iloc[-1], b["key"].iloc[-1])):
                held.append(b)
                continue
            ready = pd.concat([*held, b[~last]]) if held else b[~last]
            held = [b[last]]
            if len(ready):
                yield solve(ready)
        if held:
            yield solve(pd.concat(held))

    edges = pairs.union(rows.mapInPandas(run, "u bigint, v bigint"))
    huge = sizes.where(f"n > {bucket_limit}").select("tab", "key")
    if not huge.isEmpty():
        crowd = scratch.write(keyed.join(huge, ["tab", "key"]).select("fp").distinct(), "crowd")
        edges = edges.union(_by_midpoints(crowd, radius))
    return edges


def near_duplicates(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS,
                    bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id.

    Documents whose fingerprints differ in at most ``radius`` bits (0 to 3) are linked, and
    component_id is the smallest doc_id that a document reaches, its own included. Null and
    wordless texts have fingerprint zero and are linked like any other. Rows with a null doc_id
    get a component but never name one unless nothing else is in it (then it is null). Rows
    that repeat an id keep one row each. Other columns are ignored; an empty table gives an
    empty table.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3")
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(fingerprints(docs, words), "rows")
    prints = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(near_pairs(prints, radius, scratch, bucket_limit), scratch)
    members = prints.join(roots, prints["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    members = scratch.write(members, "members")
    named = members.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = scratch.write(members.join(named, "root").select("fp", "component_id"), "labels")
    return rows.join(labels, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = SHINGLE_WORDS, radius: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that carry their component's smallest id."""
    found = near_duplicates(docs, words, radius)
    heads = Scratch(docs.sparkSession, "heads").write(
        found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
            F.col("doc_id").alias("_head")).distinct(), "ids")
    return docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id")).join(
        heads, F.col("_id").eqNullSafe(F.col("_head")), "left_semi").select("_doc.*")
