"""Token tables, n-gram counts per group and the most frequent n-grams of each group."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from gradeloom.functions.constants import TOP_N
from gradeloom.functions.text import content_tokens, gram_runs, ngrams
from gradeloom.operators.ranking import top_per_group
from gradeloom.sources.staging import stage
from gradeloom.sources.tables import task_count

# Ship the functions below with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows a task collects before it cuts its lists again.
HELD_ROWS = 1 << 16
# Characters of documents whose n-grams a task counts together.
HELD_CHARS = 1 << 24
# Bits of the filter for listed n-grams: so many for each of them, within bounds.
FILTER_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 26
# Hash cells in which n-grams of all groups are counted, parts that they are summed in, and fullest
# cells, as times the length of a list, whose n-grams a task proposes.
CELLS, SLICES, PROPOSED = 1 << 20, 16, 4


def token_table(docs: DataFrame, doc: str, text: str = "full_text", group: str = "prompt_name",
                order: str = "row_id",
                tokenise: Callable[[Column], Column] = content_tokens) -> DataFrame:
    """One row per document: ``doc_key, group_key, row_key, tokens``, partitioned by document.

    A task gets a bounded share of the input. The exchange carries texts, half the size of
    their tokens, and every step after it has tasks of one size.
    """
    keyed = docs.select(
        F.col(doc).alias("doc_key"), F.col(group).alias("group_key"),
        F.col(order).alias("row_key"), F.col(text).alias("text"))
    return keyed.repartition(task_count(docs), "doc_key").select(
        "doc_key", "group_key", "row_key", tokenise(F.col("text")).alias("tokens"))


def doc_runs(tokens: DataFrame, n: int = 2) -> DataFrame:
    """The n-grams of each document in its row: ``runs`` of ``gram, repeats, first_pos``."""
    return tokens.select("doc_key", "group_key", "row_key",
                         gram_runs(ngrams(F.col("tokens"), n)).alias("runs"))


def run_rows(runs: DataFrame) -> DataFrame:
    """One row per n-gram of ``doc_runs``, and one with a null ``gram`` for documents without any."""
    return runs.select("doc_key", "group_key", "row_key", F.explode_outer("runs").alias("run")).select(
        "doc_key", "group_key", "row_key", "run.gram",
        F.coalesce("run.repeats", F.lit(0).cast("bigint")).alias("repeats"), "run.first_pos")


def doc_ngrams(tokens: DataFrame, n: int = 2) -> DataFrame:
    """Distinct n-grams per document with repeat count and first position.

    ``tokens`` has one row per document, in which its n-grams are sorted and counted; no table of
    them is kept. A document without n-grams keeps one row whose ``gram`` is null.
    """
    return run_rows(doc_runs(tokens, n))


def token_bodies(tokens: DataFrame) -> DataFrame:
    """A token table with ``body``, the tokens joined by blanks, which no token holds."""
    return tokens.select("doc_key", "group_key", "row_key", F.array_join("tokens", " ").alias("body"))


def joined(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One whole number for each pair of numbers from 0, different for different pairs."""
    if not len(low):
        return low
    if (int(high.max()) + 1) * (int(low.max()) + 1) >= 1 << 63:
        high, low = (np.unique(side, return_inverse=True)[1].astype(np.int64) for side in (high, low))
    return high * (int(low.max()) + 1) + low


class Places:
    """The n-grams of some documents as numbers: ``docs`` and ``pos`` say where each starts."""

    def __init__(self, bodies: pa.Array, n: int):
        lists = pc.split_pattern(pc.fill_null(bodies, ""), " ")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        pos = np.arange(len(codes)) - (np.cumsum(sizes) - sizes)[doc]
        # An empty body is split into one empty token.
        empty = pc.index(coded.dictionary, "").as_py()
        starts = np.flatnonzero((pos + n <= sizes[doc]) & (codes != empty))
        self.names, self.docs, self.pos = coded.dictionary, doc[starts], pos[starts]
        self.words = [codes[starts + i] for i in range(n)]

    def take(self, at: np.ndarray) -> None:
        """Go on with the n-grams at ``at`` alone."""
        self.docs, self.pos = self.docs[at], self.pos[at]
        self.words = [word[at] for word in self.words]

    def keys(self) -> np.ndarray:
        """Numbers that are equal for equal n-grams."""
        keys = self.words[0]
        for word in self.words[1:]:
            keys = joined(keys, word)
        return keys

    def grams(self) -> pa.Array:
        parts = [self.names.take(pa.array(word)) for word in self.words]
        return parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")

    def hashes(self) -> np.ndarray:
        """A hash of each n-gram, the same in every task."""
        names = np.fromiter(map(xxhash.xxh3_64_intdigest, self.names.to_pylist()), np.uint64,
                            len(self.names))
        out = names[self.words[0]]
        for word in self.words[1:]:
            out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + names[word]
        return out ^ (out >> np.uint64(32))


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the different ``keys`` and how often each occurs."""
    order = np.argsort(keys, kind="stable")
    kept = keys[order]
    starts = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1]))[:len(kept)])
    return order[starts], np.diff(starts, append=len(kept))


def held_tables(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[pa.Table]:
    """Batches with a ``body`` column put together until they hold about ``chars`` of text."""
    held, size = [], 0
    for batch in batches:
        rows = max(1, len(batch) * chars // max(chars, batch["body"].nbytes))
        for at in range(0, len(batch), rows):
            held.append(batch.slice(at, rows))
            size += held[-1]["body"].nbytes
            if size >= chars:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _grouped(table: pa.Table, n: int) -> tuple[pa.Table, Places, np.ndarray, np.ndarray]:
    """The documents by ``row_key``, their n-grams, and the group's number and cell of each."""
    rows = table.take(pc.sort_indices(table["row_key"]))
    found = Places(rows["body"].combine_chunks(), n)
    groups = rows["group_key"].combine_chunks().dictionary_encode(null_encoding="encode")
    names = np.array([xxhash.xxh3_64_intdigest(repr(g)) for g in groups.dictionary.to_pylist()], np.uint64)
    group = groups.indices.to_numpy().astype(np.int64)[found.docs]
    cells = (found.hashes() + names[group]) % np.uint64(CELLS)
    return rows, found, group, cells.astype(np.int64)


def _counted(rows: pa.Table, found: Places, group: np.ndarray) -> pa.Table:
    first, repeats = runs_of(joined(group, found.keys()))
    found.take(first)
    doc = pa.array(found.docs)
    return pa.table([
        rows["group_key"].take(doc), rows["row_key"].take(doc), found.grams(),
        pa.array(repeats.astype(np.int64)), pa.array(found.pos.astype(np.int32)),
    ], names=["group_key", "row_key", "gram", "repeats", "first_pos"])


def task_grams(bodies: DataFrame, n: int = 2, totals: Broadcast | None = None,
               chars: int = HELD_CHARS) -> DataFrame:
    """``group_key, row_key, gram, repeats, first_pos``: n-grams counted over documents of a task.

    The rows are for ``gram_counts``: ``row_key`` and ``first_pos`` are the first place of an n-gram
    among documents that were counted together. Tokens are numbered, so that n-grams are
    counted as whole numbers and only different ones become strings. With ``totals`` of cells
    n-grams are left out whose cell holds less than the document's ``bound``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in held_tables(batches, chars):
            rows, found, group, cells = _grouped(table, n)
            if totals is not None:
                bound = pc.fill_null(rows["bound"], 0).to_numpy()
                at = np.flatnonzero(totals.value[cells] >= bound[found.docs])
                found.take(at)
                group = group[at]
            yield from _counted(rows, found, group).to_batches(1 << 16)

    columns = ["group_key", "row_key", "body", *(["bound"] if totals is not None else [])]
    schema = bodies.select("group_key", "row_key").schema.add("gram", "string").add(
        "repeats", "long").add("first_pos", "integer")
    return bodies.select(*columns).mapInArrow(run, schema)


def _summed(slices: DataFrame) -> DataFrame:
    """``slice, counts``: the sums of the counts that a task has of a slice of cells."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist()):
                counts = np.frombuffer(counts, np.int64)
                sums[at] = sums[at] + counts if at in sums else counts
        for at, counts in sums.items():
            yield pa.record_batch([pa.array([at], pa.int32()), pa.array([counts.tobytes()], pa.binary())],
                                  names=["slice", "counts"])

    return slices.mapInArrow(run, "slice int, counts binary")


def listed_counts(bodies: DataFrame, top: int = TOP_N, n: int = 2, chars: int = HELD_CHARS) -> DataFrame:
    """The rows of ``gram_counts`` that may be among the ``top`` of their group.

    A first pass counts all n-grams by cell of a hash, and those of the fullest cells of the
    documents counted together one by one. Sums of the latter are no more than the true counts, so the
    ``top``-th of them is a bound for the list; a cell's total is no less than the count of each
    n-gram in it. The second pass counts exactly what lies in cells that reach the bound. So lists cut
    from either are the same, whatever the hash does; groups without a bound are counted whole.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for table in held_tables(batches, chars):
            rows, found, group, cells = _grouped(table, n)
            total += np.bincount(cells, minlength=CELLS)
            different, at, uses = np.unique(
                group * CELLS + cells, return_inverse=True, return_counts=True)
            owner = different // CELLS
            order = np.lexsort((uses, owner))
            ends = np.searchsorted(owner, np.arange(group.max(initial=-1) + 1), "right")
            starts = np.append(0, ends)[:-1]
            least = uses[order][np.minimum(np.maximum(ends - PROPOSED * top, starts), len(uses) - 1)]
            fullest = np.flatnonzero(uses[at] >= least[group])
            found.take(fullest)
            part = _counted(rows, found, group[fullest]).select(["group_key", "gram", "repeats"])
            none = pa.nulls(len(part))
            yield from part.append_column("slice", none.cast(pa.int32())).append_column(
                "counts", none.cast(pa.binary())).to_batches(1 << 16)
        for i, some in enumerate(np.split(total, SLICES)):
            if some.any():
                yield pa.record_batch([
                    pa.nulls(1, group_type), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()),
                    pa.array([i], pa.int32()), pa.array([some.tobytes()], pa.binary())],
                    names=["group_key", "gram", "repeats", "slice", "counts"])

    schema = bodies.select("group_key").schema
    group_type = to_arrow_type(schema["group_key"].dataType)
    schema = schema.add("gram", "string").add("repeats", "long").add("slice", "integer").add(
        "counts", "binary")
    seen = stage(bodies.select("group_key", "row_key", "body").mapInArrow(run, schema), "cells")
    sums = seen.where("gram IS NOT NULL").groupBy("group_key", "gram").agg(F.sum("repeats").alias("uses"))
    best = top_per_group(sums, ["group_key"], [F.desc("uses")], top, spread_by="gram")
    bounds = stage(best.groupBy("group_key").agg(
        F.min("uses").alias("bound"), F.count(F.lit(1)).alias("size")).where(
        F.col("size") == top).select("group_key", "bound"), "bounds")
    totals = np.zeros(CELLS, np.int64)
    slices = _summed(seen.where("slice IS NOT NULL").select("slice", "counts"))
    for row in _summed(slices.repartition("slice")).toLocalIterator():
        counts = np.frombuffer(row.counts, np.int64)
        totals[row.slice * len(counts):(row.slice + 1) * len(counts)] = counts
    bounded = bodies.join(bounds, "group_key", "left")
    return gram_counts(task_grams(
        bounded, n, bodies.sparkSession.sparkContext.broadcast(totals), chars))


def gram_filter(top: DataFrame, n: int = 2) -> np.ndarray:
    """Bits by hash of the listed n-grams, ``FILTER_BITS`` for each of them up to ``MOST_BITS``.

    It may let others through, so its bounded size costs time and no result.
    """
    size = LEAST_BITS
    while size < min(MOST_BITS, FILTER_BITS * top.count()):
        size *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size, bool)
        for batch in batches:
            bits[Places(batch["body"], n).hashes() % np.uint64(size)] = True
        yield pa.record_batch([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["bits"])

    out = np.zeros(size // 8, np.uint8)
    for row in top.select(F.col("gram").alias("body")).mapInArrow(run, "bits binary").toLocalIterator():
        out |= np.frombuffer(row.bits, np.uint8)
    return out


def listed_grams(bodies: DataFrame, top: DataFrame | None, n: int = 2,
                 chars: int = HELD_CHARS) -> DataFrame:
    """``doc_key, group_key, own_grams, gram, repeats``: a document's n-grams that may be in ``top``.

    Others are left out by ``gram_filter``, all that are listed stay; without ``top`` all n-grams do.
    ``own_grams`` is the number of different n-grams of the document; one without any row of its own
    has a null ``gram``.
    """
    held = None
    if top is not None:
        held = bodies.sparkSession.sparkContext.broadcast(gram_filter(top, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(held.value).view(bool) if held is not None else np.ones(1, bool)
        for table in held_tables(batches, chars):
            found = Places(table["body"].combine_chunks(), n)
            keys = joined(found.docs, found.keys())
            # Documents follow each other in the order of these numbers.
            kept = np.sort(keys)
            new = np.flatnonzero(np.concatenate(([True], kept[1:] != kept[:-1]))[:len(kept)])
            own = np.bincount(found.docs[new], minlength=len(table))
            may = np.flatnonzero(bits[found.hashes() % np.uint64(len(bits))])
            found.take(may)
            first, repeats = runs_of(keys[may])
            found.take(first)
            ends = np.cumsum(np.bincount(found.docs, minlength=len(table)))
            runs = pa.StructArray.from_arrays(
                [found.grams(), pa.array(repeats.astype(np.int64))], ["gram", "repeats"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), runs)
            yield from pa.table([table["doc_key"], table["group_key"], pa.array(own.astype(np.int64)), lists],
                                names=["doc_key", "group_key", "own_grams", "runs"]).to_batches(1 << 12)

    schema = bodies.select("doc_key", "group_key").schema.add("own_grams", "long").add(
        "runs", T.ArrayType(T.StructType().add("gram", "string").add("repeats", "long")))
    return bodies.select("doc_key", "group_key", "body").mapInArrow(run, schema).select(
        "doc_key", "group_key", "own_grams", F.explode_outer("runs").alias("run")).select(
        "doc_key", "group_key", "own_grams", "run.gram", "run.repeats")


def gram_counts(grams: DataFrame) -> DataFrame:
    """Occurrences per group and n-gram, with the place it was first seen.

    Input is already one row per document and gram, so map-side combining starts from the
    reduced rows and a frequent gram reaches its reducer once per task.
    """
    return grams.where(F.col("gram").isNotNull()).groupBy("group_key", "gram").agg(
        F.sum("repeats").alias("occurrences"),
        F.min("row_key").alias("first_row"),
        F.min_by("first_pos", "row_key").alias("first_pos"))


def _task_top(n: int):
    """What a task may contribute to the lists: the first n of each group among its rows.

    Rows are not sorted: once a group holds n, rows with fewer occurrences than its n-th pass by.
    """
    order = [("_group", "ascending"), ("occurrences", "descending"), ("first_row", "ascending"),
             ("first_pos", "ascending")]

    def cut(rows: pa.Table) -> tuple[pa.Table, dict]:
        groups = rows["group_key"].combine_chunks().dictionary_encode(null_encoding="encode")
        at = pc.sort_indices(rows.append_column("_group", groups.indices), sort_keys=order,
                             null_placement="at_start")
        rows, codes = rows.take(at), groups.indices.take(at).to_numpy()
        rank = np.arange(len(codes)) - np.searchsorted(codes, codes)
        last = np.flatnonzero(rank == n - 1)
        names, uses = groups.dictionary.to_pylist(), rows["occurrences"].to_numpy()
        return rows.filter(pa.array(rank < n)), {
            names[c]: u for c, u in zip(codes[last], uses[last])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, most, least = [], 0, HELD_ROWS, {}
        for batch in batches:
            if least and len(batch):
                groups = batch["group_key"].dictionary_encode(null_encoding="encode")
                bound = np.array([least.get(g, 0) for g in groups.dictionary.to_pylist()])
                batch = batch.filter(pa.array(
                    batch["occurrences"].to_numpy() >= bound[groups.indices.to_numpy()]))
            held.append(batch)
            size += len(batch)
            if size > most:
                rows, least = cut(pa.Table.from_batches(held))
                held, size = rows.to_batches(), len(rows)
                most = 2 * size + HELD_ROWS
        if size:
            yield from cut(pa.Table.from_batches(held))[0].to_batches()
    return run


def top_grams(counts: DataFrame, n: int = TOP_N) -> DataFrame:
    """The n most frequent n-grams of each group; ties go to the one seen first.

    Each task cuts its counts to n per group where they are made, so they are shuffled once.
    """
    order = [F.desc("occurrences"), F.asc("first_row"), F.asc("first_pos")]
    fewer = counts.mapInArrow(_task_top(n), counts.schema)
    return top_per_group(fewer, ["group_key"], order, n, spread_by="gram")
