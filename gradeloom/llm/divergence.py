"""Source divergence audit with late string materialisation.

1. One scan counts the terms of each (language, source) group inside the task and writes rows of
   fixed-width digests next to the terms themselves. The table is columnar: the jobs that
   shuffle counts read its digest columns only, so no term is shuffled there.
2. Counts by group and digest give the candidates: a digest is in at least as many documents as any
   term that has it. For candidates alone the smallest and the largest term of each digest are
   found. Where they differ the digest stands for several terms and is split: its counts are taken
   again by digest and term, which gives each term a number of its own.
3. Everything after that - probabilities, divergences, ranks - runs on digests. A group's best
   terms are cut by value with all ties, and just those rows are joined to their texts.

Language and source travel as digests too, seeded so that no two groups share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import Scratch
from gradeloom.operators.ranking import top_per_group

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
DIGEST_BITS = 64
# Bytes of texts that a task counts together.
HELD_BYTES = 16 << 20
# Cells of a block of terms by sources, and sources whose pairs are summed at a time.
CELLS = 1 << 20
TILE = 1024

# Bytes of a term: A-Z (lower-cased), a-z and all bytes of characters beyond ASCII.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32
               for b in range(256))


def _groups(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """lang, source and their digests lid and gid, and the seed that keeps the digests apart."""
    found = scratch.write(rows.select("lang", "source").distinct(), "groups")
    for seed in count():
        groups = found.withColumn("lid", _lid(seed)).withColumn("gid", _gid(seed))
        shared = groups.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("n")
        mixed = groups.groupBy("lid").agg(
            F.min("lang").alias("a"), F.max("lang").alias("b")).where("a != b").select("lid")
        if shared.isEmpty() and mixed.isEmpty():
            return groups, seed


def _lid(seed: int) -> Column:
    return F.xxhash64("lang", F.lit(seed))


def _gid(seed: int) -> Column:
    return F.xxhash64("lang", "source", F.lit(seed))


def term_rows(rows: DataFrame, seed: int, bits: int = DIGEST_BITS) -> DataFrame:
    """lid, gid, digest, term, n, docs, named: counts of a task's documents.

    ``named`` is true once for each term that the task writes out together, so that a reader of
    texts meets each of them once and not for every group.
    """
    mask = (1 << bits) - 1

    def counted(texts: list[bytes], lid: np.ndarray, gid: np.ndarray) -> pa.RecordBatch:
        words = pc.split_pattern(pa.array(texts, pa.binary()), b" ")
        sizes = pc.list_value_length(words).to_numpy(zero_copy_only=False)
        coded = words.flatten().dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        size = len(names)
        pairs, uses = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + codes, return_counts=True)
        empty = pc.index(names, pa.scalar(b"", pa.binary())).as_py()
        doc, code = pairs // size, pairs % size
        held = code != empty
        doc, code, uses = doc[held], code[held], uses[held]
        groups, first, group = np.unique(gid, return_index=True, return_inverse=True)
        keys = group[doc] * size + code
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
        code, owner = keys[starts] % size, keys[starts] // size
        digest = np.fromiter((xxhash.xxh64_intdigest(k) & mask for k in names.to_pylist()), np.uint64, size)
        named = np.zeros(len(code), bool)
        named[np.unique(code, return_index=True)[1]] = True
        n = np.add.reduceat(uses[order], starts) if len(starts) else uses
        return pa.record_batch(
            [pa.array(lid[first][owner]), pa.array(groups[owner]), pa.array(digest[code].view(np.int64)),
             names.take(pa.array(code)), pa.array(n.astype(np.int64)),
             pa.array(np.diff(starts, append=len(keys)).astype(np.int64)), pa.array(named)],
            names=["lid", "gid", "digest", "term", "n", "docs", "named"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            out = counted([t for _, _, t in held], np.array([a for a, _, _ in held]),
                          np.array([b for _, b, _ in held]))
            for at in range(0, len(out), 1 << 16):
                yield out.slice(at, 1 << 16)
            held.clear()

        for b in batches:
            for lid, gid, text in zip(b["lid"].to_pylist(), b["gid"].to_pylist(), b["raw"]):
                held.append((lid, gid, text.as_py().translate(_TERMS)))
                size += len(held[-1][2])
                if size >= HELD_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return rows.select(_lid(seed).alias("lid"), _gid(seed).alias("gid"),
                       F.col("text").cast("binary").alias("raw")).mapInArrow(
        run, "lid bigint, gid bigint, digest bigint, term binary, n bigint, docs bigint, "
             "named boolean")


def _kept(counts: DataFrame, min_docs: int) -> DataFrame:
    return counts.groupBy("lid", "digest", "sub").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(
        F.col("docs") >= min_docs).select("lid", "digest", "sub", "lang_n")


def kept_terms(found: DataFrame, min_docs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lid, gid, digest, sub, n, lang_n) and their texts (digest, sub, item)."""
    counts = scratch.write(found.groupBy("lid", "gid", "digest").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("sub", F.lit(0)), "counts", free=True)
    kept = scratch.write(_kept(counts, min_docs), "candidates", free=True)
    texts = scratch.write(found.where("named").select("digest", "term").join(
        kept.select("digest").distinct(), "digest", "left_semi").groupBy("digest").agg(
        F.min("term").alias("low"), F.max("term").alias("high")), "texts", free=True)
    names = texts.where("low = high").select("digest", F.lit(0).alias("sub"), F.col("low").alias("item"))
    shared = texts.where("low != high").select("digest")
    if not shared.isEmpty():
        mixed = found.join(shared, "digest", "left_semi")
        # Terms of one digest are few, so their numbers come from a window by digest.
        own = scratch.write(mixed.where("named").select("digest", "term").distinct().withColumn(
            "sub", F.row_number().over(Window.partitionBy("digest").orderBy("term"))), "split")
        again = mixed.join(own, ["digest", "term"]).groupBy("lid", "gid", "digest", "sub").agg(
            F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        counts = scratch.write(counts.join(shared, "digest", "left_anti").unionByName(again), "recounted")
        kept = scratch.write(_kept(counts, min_docs), "kept")
        names = names.union(own.select("digest", "sub", F.col("term").alias("item")))
    rows = scratch.write(counts.join(kept, ["lid", "digest", "sub"]).select(
        "lid", "gid", "digest", "sub", "n", "lang_n"), "rows", free=True)
    for table in (found, counts, kept):
        scratch.drop(table)
    return rows, names.withColumn("item", F.col("item").cast("string"))


def share(uses: Column, total: Column, terms_kept: Column) -> Column:
    """1 + floor(SCALE * (uses + 2) / (total + 2 * terms)), exact for any count."""
    top = F.lit(SCALE).cast("decimal(10,0)") * (uses + 2).cast("decimal(20,0)")
    return 1 + F.call_function("div", top, (total + 2 * terms_kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """lid, a, b (places of sources, a < b) and the divergence summed over the terms of a task."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, total = None, None

        def done() -> Iterator[pd.DataFrame]:
            if total is not None:
                a, b = np.nonzero(total)
                yield pd.DataFrame({"lid": at[0], "a": a + at[1] * TILE, "b": b, "total": total[a, b]})

        for batch in batches:
            for key, part in batch.groupby(["lid", "tile"], sort=False):
                zero = np.asarray(part["zeros"].iloc[0])
                size, first = len(zero), key[1] * TILE
                if key != at:
                    yield from done()
                    at, total = key, np.zeros((min(TILE, size - first), size), np.int64)
                step = max(1, CELLS // size)
                for i in range(0, len(part), step):
                    some = part.iloc[i:i + step]
                    p = np.tile(zero, (len(some), 1))
                    lengths = some["places"].map(len).to_numpy()
                    p[np.repeat(np.arange(len(some)), lengths),
                      np.concatenate(some["places"].tolist())] = np.concatenate(some["shares"].tolist())
                    for j in range(len(total)):
                        own, other = p[:, first + j, None], p[:, first + j + 1:]
                        gap = own - other
                        total[j, first + j + 1:] += (gap * gap // (own + other)).sum(axis=0)
        yield from done()

    return vectors.mapInPandas(run, "lid bigint, a bigint, b bigint, total bigint")


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS,
                      digest_bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: how far sources of a language differ.

    Part ``pair`` has all other sources of the language, part ``term`` the ``top`` terms that the source
    has more of than its language. Terms are runs of letters and of characters beyond ASCII; a
    language keeps those in at least ``min_docs`` of its documents. Null text, lang and source are
    ''. Ties go to the smaller item in UTF-8. Every row is a document, repeated ones too; doc_id
    and other columns are not read. Long texts are counted whole. An empty table, or a language
    without kept terms, gives no term rows; its sources are pairs of value 0.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "divergence")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
                         for c in ("lang", "source", "text")))
    groups, seed = _groups(rows, scratch)
    found = scratch.write(term_rows(rows, seed, digest_bits), "terms")
    kept, names = kept_terms(found, min_docs, scratch)

    langs = kept.groupBy("lid").agg(
        F.sum("n").alias("lang_total"), F.count_distinct("digest", "sub").alias("terms"))
    totals = kept.groupBy("gid").agg(F.sum("n").alias("total"))
    place = F.row_number().over(Window.partitionBy("lid").orderBy("source")) - 1
    # One row per group; sources of a language meet in a window, as in the result.
    stats = scratch.write(groups.join(langs, "lid", "left").join(totals, "gid", "left").fillna(
        0, ["lang_total", "terms", "total"]).withColumn("place", place), "stats")
    own = stats.select("gid", "place", "total", "lang_total", "terms")
    zeros = scratch.write(stats.where("terms > 0").groupBy("lid").agg(F.sort_array(F.collect_list(
        F.struct("place", share(F.lit(0), F.col("total"), F.col("terms")).alias("p")))).alias("z"))
        .select("lid", F.col("z.p").alias("zeros")), "zeros")
    shares = kept.join(own, "gid").select(
        "lid", "gid", "digest", "sub", "place",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))

    # Each term has at most one entry per source.
    vectors = shares.groupBy("lid", "digest", "sub").agg(
        F.collect_list(F.struct("place", "p")).alias("v")).join(zeros, "lid").select(
        "lid", "zeros", F.col("v.place").alias("places"), F.col("v.p").alias("shares"),
        F.explode(F.sequence(F.lit(0), F.floor((F.size("zeros") - 1) / TILE).cast("int"))).alias("tile")
    ).sortWithinPartitions("lid", "tile")
    sums = scratch.write(_pair_sums(vectors).groupBy("lid", "a", "b").agg(
        F.sum("total").alias("total")), "sums", free=True)
    both = sums.union(sums.select("lid", "b", "a", "total")).select(
        "lid", F.col("a").cast("int").alias("place"), F.col("b").cast("int").alias("other_place"), "total")
    other = stats.select("lid", F.col("place").alias("other_place"), F.col("source").alias("item"))
    # The pairs of sources of a language are the result itself.
    pairs = stats.select("lid", "lang", "source", "place").join(other, "lid").where(
        "place != other_place").join(both, ["lid", "place", "other_place"], "left").select(
        "lang", "source", "item", F.coalesce("total", F.lit(0)).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    scored = scratch.write(shares.where("p > q").select(
        "gid", "digest", "sub", divergence(F.col("p"), F.col("q")).alias("value")), "scored")
    limit = scratch.write(top_per_group(
        scored, ["gid"], [F.desc("value"), F.asc("digest"), F.asc("sub")], top,
        spread_by="digest").groupBy("gid").agg(F.min("value").alias("least")), "limit")
    tied = scratch.write(scored.join(limit, "gid").where("value >= least").select(
        "gid", "digest", "sub", "value"), "tied")
    # Only here do rows of groups meet the texts of their terms.
    named = tied.join(names, ["digest", "sub"]).select("gid", "item", "value")
    best = top_per_group(named, ["gid"], [F.desc("value"), F.asc("item")], top, spread_by="item")
    best = best.join(stats.select("gid", "lang", "source"), "gid")
    out = [part.select("lang", "source", F.lit(name).alias("part"), "item", "value",
                       F.col("rank").cast("int").alias("rank"))
           for name, part in (("pair", pairs), ("term", best))]
    return out[0].union(out[1])
