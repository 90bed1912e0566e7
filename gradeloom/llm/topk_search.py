"""Exact inner-product search by columnar branch and bound.

Vectors are stored in blocks, one row per block, dimension by dimension. A cell is a share of the
candidate blocks and a share of the query blocks; one task searches it, a block of queries against
a block of candidates at a time. Scores grow by groups of dimensions, the heaviest first. After a
group, what the remaining dimensions can still add is at most the product of the remaining lengths
of both vectors; pairs that cannot reach the query's k-th best score drop out, and the survivors
are compacted before the next group. The k-th best score carries over from block to block of a cell.

The query set is stated by the caller and compared with all rows. Blocks of both kinds are dealt to
cells as rows of one table, candidates first, so no row holds a pair of blocks and nothing is
broadcast or passes the driver, whatever the planner takes for small.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import Scratch

K = 20
BLOCK_ROWS = 4096
QUERY_ROWS = 256
GROUP = 16
# Bytes of a block's numbers at eight each, and of the candidates of a cell.
BLOCK_BYTES = 2 * 2 ** 20
CELL_BYTES = 32 * 2 ** 20
# Once at most one pair in so many is left, the rest is summed pair by pair.
FEW = 256
# Whole numbers below these are exact in floats and in doubles.
SAFE_FLOAT, SAFE = 2.0 ** 24, 2.0 ** 52
# Largest score; larger ones count as this, so that every score and its negative fit 64 bits.
MOST = 2 ** 63 - 1


def usable(vector: Column) -> Column:
    """True for vectors without null, NaN or infinite components."""
    inf = float("inf")
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        x != F.lit(inf)) & (x != F.lit(-inf)))


def _pack(grid: np.ndarray) -> bytes:
    """The bytes of ``grid`` in the narrowest whole numbers that hold it."""
    low, high = grid.min(initial=0), grid.max(initial=0)
    fits = (t for t in ("<i1", "<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max)
    return grid.astype(next(fits)).tobytes()


def _unpack(raw: bytes, dims: int, rows: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{len(raw) // (dims * rows)}").reshape(dims, rows)


def vector_blocks(vectors: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``vectors`` (row, vec_id, values array<bigint>) to rows of rows, ids, dims and columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            widest = max([1, *map(len, b["values"])])
            step = max(1, min(block_rows, BLOCK_BYTES // (8 * widest)))
            for at in range(0, len(b), step):
                part = b.iloc[at:at + step]
                dims = max(1, *map(len, part["values"]))
                # Shorter vectors have zeros in the dimensions that they lack.
                grid = np.zeros((dims, len(part)), "<i8")
                for i, v in enumerate(part["values"]):
                    grid[:len(v), i] = v
                yield pd.DataFrame({"rows": [part["row"].to_numpy("<i8").tobytes()],
                                    "ids": [part["vec_id"].to_numpy("<i8").tobytes()],
                                    "dims": [dims], "columns": [_pack(grid)]})

    return vectors.mapInPandas(
        run, "rows binary, ids binary, dims int, columns binary").withColumn(
        "block", F.monotonically_increasing_id())


class Candidates:
    """A block of candidates, one per vertical line, and what all queries need of it."""

    def __init__(self, columns: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.columns, self.ids, self.rows = columns, ids, rows
        self.top = max(1.0, float(np.abs(columns.astype(np.float64)).max(initial=0)))
        self.known: dict[type, tuple] = {}

    def grouped(self, kind: type) -> tuple[np.ndarray, np.ndarray, list[int], list[np.ndarray]]:
        """The order of dimensions, the columns in it, the cuts, and remaining lengths after each."""
        if kind not in self.known:
            cols = self.columns.astype(np.float64)
            order = np.argsort(-(cols ** 2).sum(axis=1), kind="stable")
            cols = cols[order]
            cuts = [*range(0, len(cols), GROUP), len(cols)]
            rest = [np.sqrt((cols[c:] ** 2).sum(axis=0)).astype(kind) for c in cuts[1:]]
            self.known[kind] = order, cols.astype(kind), cuts, rest
        return self.known[kind]


class Best:
    """The k best candidates of each query of one block."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, k: int):
        self.queries, self.rows, self.k = queries, rows, k
        self.top = max(1.0, float(np.abs(queries.astype(np.float64)).max(initial=0)))
        # Sorted by query (its place in the block), falling score and id.
        self.at, self.scores, self.ids = (np.empty(0, np.int64) for _ in range(3))

    def limits(self) -> np.ndarray:
        """The k-th best score of every query; -inf where there are fewer."""
        ends = np.searchsorted(self.at, np.arange(len(self.rows)), "right")
        full = np.bincount(self.at, minlength=len(self.rows)) == self.k
        limits = np.full(len(self.rows), -np.inf)
        limits[full] = self.scores[ends[full] - 1]
        return limits

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        at, scores, ids = (np.concatenate(pair) for pair in (
            (self.at, at), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, at))
        at = at[order]
        kept = np.arange(len(at)) - np.searchsorted(at, at) < self.k
        self.at, self.scores, self.ids = at[kept], scores[order[kept]], ids[order[kept]]

    def search(self, block: Candidates) -> None:
        """Add the candidates of ``block`` to every query's best."""
        # A dimension that one side lacks adds nothing.
        dims = len(block.columns)
        query = np.zeros((len(self.queries), dims), self.queries.dtype)
        query[:, :self.queries.shape[1]] = self.queries[:, :dims]
        largest = self.top * block.top * dims
        if largest >= SAFE:
            # Doubles would round: whole numbers of any size, without bounds.
            wide = query.astype(object) @ block.columns.astype(object)
            wide = np.minimum(np.maximum(wide, -MOST), MOST).astype(np.int64)
            at, other = np.nonzero(self.rows[:, None] != block.rows[None, :])
            self.add(at, wide[at, other], block.ids[other])
            return
        kind = np.float32 if largest < SAFE_FLOAT else np.float64
        order, cols, cuts, rest_c = block.grouped(kind)
        query = query[:, order].astype(kind)
        # The slack covers rounding of the roots; it can only keep more.
        rest_q = [np.sqrt((query[:, c:].astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-6)
                  for c in cuts[1:]]
        score = query[:, :cuts[1]] @ cols[:cuts[1]]
        _, mine, own = np.intersect1d(self.rows, block.rows, assume_unique=True, return_indices=True)
        score[mine, own] = -np.inf
        limits = self.limits()
        if cols.shape[1] > self.k:
            # Any k candidates give a valid limit; likely ones give a high one.
            for i in np.flatnonzero(limits == -np.inf):
                seeds = np.argpartition(-score[i], self.k)[:self.k + 1]
                seeds = seeds[score[i, seeds] > -np.inf][:self.k]
                if len(seeds) == self.k:
                    limits[i] = float((query[i] @ cols[:, seeds]).min())
        limits = np.maximum(limits, -2 * SAFE)
        alive = np.arange(cols.shape[1])
        for g, rest in enumerate(rest_c):
            if g:
                score += query[:, cuts[g]:cuts[g + 1]] @ cols[cuts[g]:cuts[g + 1], alive]
            # Limit less the product of the remaining lengths, for all pairs at once.
            least = np.stack([limits, -rest_q[g]], axis=1).astype(kind) @ np.stack(
                [np.ones(len(alive), kind), rest[alive]])
            stay = score >= least
            if np.count_nonzero(stay) * FEW <= stay.size:
                break
            # A candidate goes once no query of the block needs it.
            some = stay.any(axis=0)
            if not some.all():
                alive, score, stay = alive[some], score[:, some], stay[:, some]
        if g == len(rest_c) - 1 and len(alive) > self.k < np.count_nonzero(stay) / len(query):
            # Sums are whole: no more than the block's own k best of a query, and ties, are kept.
            stay &= score >= -np.partition(-score, self.k - 1, axis=1)[:, self.k - 1:self.k]
        at, place = np.nonzero(stay)
        sums, place = score[at, place], alive[place]
        for h in range(g + 1, len(rest_c)):
            near = slice(cuts[h], cuts[h + 1])
            sums = sums + (query[at, near] * cols[near, place].T).sum(axis=1)
            reach = limits[at] - rest_q[h][at] * rest_c[h][place]
            kept = sums >= reach
            at, place, sums = at[kept], place[kept], sums[kept]
        self.add(at, np.rint(sums).astype(np.int64), block.ids[place])


def grid(candidate_bytes: int, candidates: int, query_bytes: int, queries: int,
         tasks: int) -> tuple[int, int]:
    """Parts of the candidate blocks and parts of the query blocks, at least ``tasks`` cells if there
    are blocks for them: each block goes to every cell of its part, so few copies are made where the
    parts are as large as each other, and the candidates of a cell stay within ``CELL_BYTES``."""
    even = round((tasks * candidate_bytes / max(1, query_bytes)) ** 0.5)
    across = min(max(1, candidates), max(1, even, -(-candidate_bytes // CELL_BYTES)))
    return across, min(max(1, queries), -(-tasks // across))


def _part(parts: int, salt: int) -> Column:
    """Blocks of a task in turn to the parts, from a part that the task's number gives."""
    task, place = F.shiftright("block", 33), F.col("block").bitwiseAND(F.lit((1 << 33) - 1))
    return F.pmod(F.xxhash64(task, F.lit(salt)) % parts + place, F.lit(parts))


def _size(blocks: DataFrame) -> tuple[int, int]:
    """Blocks and the bytes of their numbers at eight each."""
    n, size = blocks.agg(F.count("block"), F.sum(F.octet_length("ids") * F.col("dims").cast("long"))).first()
    return n, size or 0


def top_k(vectors: DataFrame, is_query: str, k: int = K, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """``vectors`` (vec_id, values array<bigint>): query_id, rank (from 1), vec_id, score.

    Queries are the rows that meet ``is_query``, an expression on vec_id; candidates are all
    rows but the query's own. Ties go to the smaller vec_id. Rows with a null vec_id or null values
    take no part. Rows that repeat an id are vectors of their own: each is a candidate of the
    others and, if it is a query, gets its own ranks. Fewer than k candidates give all of them.
    An empty table, or no query, gives no row. Scores beyond 64 bits are the largest, or smallest,
    64-bit score and rank as such.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    vectors = scratch.write(vectors.where("vec_id is not null and values is not null").select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint"), "values"),
        "vectors")
    blocks = scratch.write(vector_blocks(vectors, block_rows), "blocks")
    asked = scratch.write(vector_blocks(vectors.where(is_query), query_rows), "queries")
    (n, size), (n_asked, asked_size) = _size(blocks), _size(asked)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    across, down = grid(size, n, asked_size, n_asked, tasks)

    def copies(part: Column, other: int, cell: Column, asks: bool, df: DataFrame) -> DataFrame:
        return df.withColumn("_part", part).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1)))).select(
            cell.cast("long").alias("cell"), F.lit(asks).alias("asks"), "block", "rows", "ids", "dims",
            "columns")

    # Rows of a cell: its candidates, then its queries.
    met = copies(_part(across, 1), down, F.col("_other") * across + F.col("_part"), False, blocks).unionAll(
        copies(_part(down, 2), across, F.col("_part") * across + F.col("_other"), True, asked))
    met = met.repartition(min(across * down, 2 * tasks), "cell").sortWithinPartitions(
        "cell", "asks", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for b in batches:
            for row in b.itertuples():
                if row.cell != at:
                    at, held = row.cell, []
                ids, rows = np.frombuffer(row.ids, "<i8"), np.frombuffer(row.rows, "<i8")
                columns = _unpack(row.columns, row.dims, len(rows))
                if not row.asks:
                    held.append(Candidates(columns, ids, rows))
                    continue
                best = Best(columns.T, rows, k)
                for block in held:
                    best.search(block)
                yield pd.DataFrame({"query_row": rows[best.at], "query_id": ids[best.at],
                                    "vec_id": best.ids, "score": best.scores})

    found = met.mapInPandas(run, "query_row bigint, query_id bigint, vec_id bigint, score bigint")
    rank = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
