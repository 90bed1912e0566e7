"""Removal of repeated passages over a sampled suffix array.

A byte is removed if a string of ``width`` bytes covers it that also starts in a document with a
smaller id. Sorting all suffixes would move every byte ``width`` times, so only anchored
suffixes are sorted. Each string of ``width`` bytes has one anchor: its leftmost ``LEAD``-byte piece
with the smallest hash. Equal strings have the same anchor at the same place, so it is enough to
compare strings whose anchors begin with the same leading bytes. About one position in
eighteen is an anchor, and strings that follow each other mostly share it; such a run is one
record with the bytes that it spans.

1. A sample of anchors gives splitters, which cut the order of leading bytes into ranges. Equal
   leading bytes never straddle a boundary. Leading bytes that fill more than one range by
   themselves are dealt over those ranges by the whole string, one record for each string.
2. Map tasks read whole texts, find the records and pack them by range. Of equal records within a
   window of texts only those of the smallest id travel; for the others the answer is known. So a
   passage that a third of all documents hold is sent once per window of texts.
3. A range sorts its suffixes by their leading bytes. Suffixes whose leading bytes no other
   document has drop out. The strings of the rest are grouped by a hash, with equality decided on
   all bytes, and each one whose group holds a smaller id is marked.
4. Marked runs meet the texts again by document and are cut out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm.common import Scratch, hidden_id, shown_id

WIDTH = 50
LEAD = 16
WINDOW = 2 << 20
RANGE_BYTES = 6 << 20
SAMPLED_DOCS = 2048
SAMPLED_PER_RANGE = 8
SAMPLED_ANCHORS = 64
CHUNK = 1 << 20
LEVEL = 3
LAST = 2**63 - 1
ODD = np.uint64(0x9E3779B97F4A7C15)


def rolling(raw: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of the ``width`` bytes from every position, by doubling."""
    part, size, out, done = raw.astype(np.uint64) + np.uint64(1), 1, None, 0
    while True:
        if width & size:
            if out is None:
                out, done = part, size
            else:
                # The new, longer piece goes in front of what is done.
                n = max(0, min(len(part), len(out) - size))
                out = part[:n] * _power(done) + out[size:size + n]
                done += size
        if size * 2 > width:
            return out
        n = max(0, len(part) - size)
        part = part[:n] * _power(size) + part[size:]
        size *= 2


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(ODD), n, 1 << 64))


def words(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from every position as a number in byte order; zeros follow the end."""
    part = np.concatenate([raw, np.zeros(7, np.uint8)]).astype(np.uint64)
    for size in (1, 2, 4):
        part = part[:-size] << np.uint64(8 * size) | part[size:]
    return part


def leading_words(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The ``LEAD`` bytes from some positions as pairs of numbers in byte order."""
    lead = raw[at[:, None] + np.arange(LEAD, dtype=np.int32)]
    return lead.view(">u8").astype(np.uint64)


def anchors(hashes: np.ndarray, span: int) -> np.ndarray:
    """Position of the leftmost smallest of the ``span`` hashes from every position."""
    best, where, size = hashes, np.arange(len(hashes), dtype=np.int32), 1

    def join(gap: int) -> None:
        nonlocal best, where
        n = len(best) - gap
        second = best[gap:] < best[:n]
        where = np.where(second, where[gap:], where[:n])
        best = np.where(second, best[gap:], best[:n])

    while size * 2 <= span:
        join(size)
        size *= 2
    if size < span:
        join(span - size)
    return where


class Records:
    """Records of one window: runs of strings with one anchor."""

    def __init__(self, texts: list[bytes], width: int):
        raw = self.raw = b"".join(texts)
        flat = np.frombuffer(raw, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes) - sizes
        empty = np.empty(0, np.int64)
        self.low = self.high = self.anchor = self.owner = empty
        if len(flat) < width:
            return
        mixed = rolling(flat, LEAD)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        at = anchors(mixed, width - LEAD + 1)
        del mixed
        inside = np.zeros(len(flat) + 1, np.int32)
        fits = sizes >= width
        np.add.at(inside, self.begin[fits], 1)
        np.add.at(inside, (self.begin + sizes - width + 1)[fits], -1)
        place = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int32) > 0)
        if not len(place):
            return
        at = at[place]
        del inside
        cut = np.flatnonzero((np.diff(at) != 0) | (np.diff(place) != 1)) + 1
        first = np.concatenate([[0], cut])
        self.low = place[first]
        self.high = place[np.concatenate([cut, [len(place)]]) - 1]
        self.anchor = at[first].astype(np.int64)
        self.owner = np.searchsorted(self.begin, self.low, "right") - 1
        pair = leading_words(flat, self.anchor)
        self.lead = pair[:, 0], pair[:, 1]


class Ranges:
    """Splitters over pairs of leading words and the numbers of the ranges between them."""

    def __init__(self, pairs: list[tuple[int, int]], ranges: int):
        pairs = sorted(pairs)
        if len(pairs) > 1 and ranges > 1:
            cuts = [pairs[i * len(pairs) // ranges] for i in range(1, ranges)]
        else:
            cuts = []
        self.first = np.array([c[0] for c in cuts], np.uint64)
        self.second = np.array([c[1] for c in cuts], np.uint64)
        self.count = len(cuts) + 1

    def bounds(self, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last range that the pair may be in; they differ for heavy pairs only."""
        low = np.searchsorted(self.first, one, "left")
        high = np.searchsorted(self.first, one, "right")
        tied = np.flatnonzero(high > low)
        if len(tied):
            order = tied[np.argsort(low[tied], kind="stable")]
            for part in np.split(order, np.flatnonzero(np.diff(low[order])) + 1):
                a, b = low[part[0]], high[part[0]]
                low[part] = a + np.searchsorted(self.second[a:b], two[part], "left")
                high[part] = a + np.searchsorted(self.second[a:b], two[part], "right")
        return low, high


def _pack(squeeze, doc, copy, lead_at, size, counts, places, content: bytes) -> bytes:
    head = struct.pack("<III", len(doc), len(places), len(content))
    return squeeze.compress(head + b"".join((
        np.ascontiguousarray(doc, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes(),
        np.ascontiguousarray(copy, "<i8").tobytes(), lead_at.astype("<u2").tobytes(),
        size.astype("<u2").tobytes(), counts.astype("<u4").tobytes(),
        places.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), content)))


def _unpack(blob: bytes) -> tuple:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, p, c = struct.unpack_from("<III", raw)
    at = 12
    doc = np.frombuffer(raw, np.uint8, 8 * n, at).reshape(8, n).T.copy().view("<i8").ravel()
    at += 8 * n
    out = [doc]
    for kind, k in (("<i8", n), ("<u2", n), ("<u2", n), ("<u4", n)):
        out.append(np.frombuffer(raw, kind, k, at))
        at += np.dtype(kind).itemsize * k
    out.append(np.frombuffer(raw, np.uint8, 4 * p, at).reshape(4, p).T.copy().view("<u4").ravel())
    at += 4 * p
    return (*out, raw[at:at + c])


def _window_rows(docs: list[tuple[int, int, int, bytes]], ranges: Ranges, width: int
                 ) -> tuple[list[tuple[int, bytes]], list[tuple]]:
    """Packed records by range, and runs (doc, copy, start, end) known to be repeated.

    ``docs`` are pieces of texts: id, copy number, offset in the text, bytes.
    """
    found = Records([d[3] for d in docs], width)
    if not len(found.low):
        return [], []
    ids = np.array([d[0] for d in docs], np.int64)
    copies = np.array([d[1] for d in docs], np.int64)
    offset = np.array([d[2] for d in docs], np.int64)
    raw, low, high, owner = found.raw, found.low, found.high, found.owner
    lead_at = found.anchor - low
    first, last = ranges.bounds(*found.lead)
    target = first
    heavy = np.flatnonzero(last > first)
    if len(heavy):
        # One record for each string, dealt by all its bytes over the ranges of its anchor.
        n = (high - low + 1)[heavy]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        back = np.repeat(heavy, n)
        start = low[back] + step
        whole = rolling(np.frombuffer(raw, np.uint8), width)[start]
        whole ^= whole >> np.uint64(31)
        wide = (last - first + 1)[back].astype(np.uint64)
        dealt = first[back] + (whole % wide).astype(np.int64)
        light = np.flatnonzero(last <= first)
        low = np.concatenate([low[light], start])
        high = np.concatenate([high[light], start])
        target = np.concatenate([first[light], dealt])
        lead_at = np.concatenate([lead_at[light], found.anchor[back] - start])
        owner = np.concatenate([owner[light], owner[back]])
    contents = [raw[a:b] for a, b in zip(low.tolist(), (high + width).tolist())]
    last_of = {c: i for i, c in enumerate(contents)}
    doc, copy = ids[owner], copies[owner]
    place = low - found.begin[owner] + offset[owner]
    known: list[tuple] = []
    group = np.arange(len(contents))
    keep = np.ones(len(contents), bool)
    if len(last_of) < len(contents):
        group = np.fromiter(map(last_of.__getitem__, contents), np.int64, len(contents))
        least = np.full(len(contents), LAST, np.int64)
        np.minimum.at(least, group, doc)
        keep = doc == least[group]
        gone = np.flatnonzero(~keep)
        known = _merged(doc[gone], copy[gone], place[gone], place[gone] + (high - low)[gone] + width)
    at = np.flatnonzero(keep)
    at = at[np.lexsort((place[at], copy[at], group[at], target[at]))]
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(group[at]) != 0) | (np.diff(copy[at]) != 0) | (np.diff(target[at]) != 0)
    heads = np.flatnonzero(new)
    counts = np.diff(np.append(heads, len(at)))
    one = at[heads]
    edges = np.flatnonzero(np.diff(target[one])) + 1
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    rows = []
    begins = np.concatenate([[0], np.cumsum(counts)])
    for part in np.split(np.arange(len(one)), edges):
        rec = one[part]
        places = place[at[begins[part[0]]:begins[part[-1] + 1]]]
        rows.append((int(target[rec[0]]), _pack(
            squeeze, doc[rec], copy[rec], lead_at[rec], (high - low)[rec] + width, counts[part],
            places, b"".join([contents[i] for i in rec.tolist()]))))
    return rows, known


def _merged(doc, copy, start, end) -> list[tuple]:
    """Runs with overlaps of one document joined."""
    if not len(doc):
        return []
    order = np.lexsort((start, copy, doc))
    doc, copy, start, end = doc[order], copy[order], start[order], end[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (copy[1:] == copy[:-1])
    # The furthest end so far within a document; documents are lifted apart to keep one pass.
    lift = np.cumsum(~same) * np.int64(1 << 32)
    far = np.maximum.accumulate(end + lift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + lift)[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return list(zip(doc[first].tolist(), copy[first].tolist(), start[first].tolist(),
                    (far[last] - lift[last]).tolist()))


def repeated_in_range(blobs: list[bytes], width: int, chunk: int = CHUNK) -> list[tuple]:
    """Runs (doc, copy, start, end) of the strings of one range that a smaller id has as well."""
    parts = [_unpack(b) for b in blobs]
    doc, copy, lead_at, size, counts, places = (
        np.concatenate([p[i] for p in parts]) for i in range(6))
    size = size.astype(np.int64)
    content = np.frombuffer(b"".join(p[6] for p in parts), np.uint8)
    del parts
    begin = np.cumsum(size) - size
    place_at = np.cumsum(counts, dtype=np.int64) - counts
    pair = leading_words(content, begin + lead_at)
    order = np.lexsort((pair[:, 1], pair[:, 0]))
    one, two = pair[order, 0], pair[order, 1]
    new = np.ones(len(order), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    first = np.flatnonzero(new)
    if not len(first):
        return []
    group = np.cumsum(new) - 1
    least = np.minimum.reduceat(doc[order], first)
    most = np.maximum.reduceat(doc[order], first)
    # Leading bytes of one document only cannot repeat a smaller id.
    order, group = order[(most > least)[group]], group[(most > least)[group]]
    if not len(order):
        return []
    # Whole groups of suffixes, some megabytes at a time.
    load = np.cumsum(size[order]) // chunk
    out: list[tuple] = []
    at = 0
    while at < len(order):
        end = np.searchsorted(load, load[at], "right")
        end = int(np.searchsorted(group, group[end - 1], "right"))
        out += _marked(order[at:end], doc, copy, size, begin, counts, places, place_at, content,
                       width)
        at = end
    return out


def _marked(records, doc, copy, size, begin, counts, places, place_at, content, width) -> list[tuple]:
    n = size[records]
    local = np.cumsum(n) - n
    step = np.arange(n.sum()) - np.repeat(local, n)
    flat = content[np.repeat(begin[records], n) + step]
    starts = n - width + 1
    back = np.repeat(np.arange(len(records)), starts)
    shift = np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    where = local[back] + shift
    key = rolling(flat, width)[where]
    order = np.argsort(key)
    key = key[order]
    tied = np.zeros(len(key), bool)
    tied[1:] = key[1:] == key[:-1]
    paired = tied.copy()
    paired[:-1] |= tied[1:]
    order, tied = order[paired], tied[paired]
    if not len(order):
        return []
    eight = words(flat)
    offsets = [*range(0, width - 7, 8), width - 8]
    same = np.ones(len(order), bool)
    for o in offsets:
        w = eight[where[order] + o]
        same[1:] &= w[1:] == w[:-1]
    if (tied & ~same).any():
        # Different strings with one hash: sort by the strings themselves.
        columns = [eight[where[order] + o] for o in offsets]
        order = order[np.lexsort(columns[::-1])]
        same[:] = True
        for o in offsets:
            w = eight[where[order] + o]
            same[1:] &= w[1:] == w[:-1]
        tied = same.copy()
    tied[0] = False
    first = np.flatnonzero(~tied)
    owner = doc[records][back[order]]
    least = np.minimum.reduceat(owner, first)[np.cumsum(~tied) - 1]
    hit = np.sort(order[owner > least])
    if not len(hit):
        return []
    rec, at = back[hit], shift[hit]
    new = np.ones(len(hit), bool)
    new[1:] = (np.diff(rec) != 0) | (np.diff(at) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(hit)) - 1
    rec, a, b = records[rec[first]], at[first], at[last] + width
    times = counts[rec].astype(np.int64)
    index = np.repeat(place_at[rec], times) + np.arange(times.sum()) - np.repeat(
        np.cumsum(times) - times, times)
    spot = places[index].astype(np.int64)
    return _merged(np.repeat(doc[rec], times), np.repeat(copy[rec], times),
                   spot + np.repeat(a, times), spot + np.repeat(b, times))


def _pieces(rows: Iterator[tuple[int, int, bytes]], width: int, window: int
            ) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Texts in windows of bounded size; longer ones in pieces that overlap by width - 1."""
    held, size = [], 0
    for doc, copy, text in rows:
        for at in range(0, max(1, len(text) - width + 1), window):
            piece = text[at:at + window + width - 1]
            held.append((doc, copy, at, piece))
            size += len(piece)
            if size >= window:
                yield held
                held, size = [], 0
    if held:
        yield held


def _numbered(docs: DataFrame) -> DataFrame:
    """doc_id, copy, raw. ``copy`` tells rows apart that share an id and have different texts."""
    raw = F.coalesce("text", F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("bigint"), raw.alias("raw"))
    repeated = rows.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(
        F.col("doc_id").alias("again"), F.lit(True).alias("more"))
    if repeated.isEmpty():
        return rows.select("doc_id", F.lit(0).cast("bigint").alias("copy"), "raw")
    repeated = Scratch(docs.sparkSession, "repeated").write(repeated, "ids")
    return rows.join(repeated, rows["doc_id"].eqNullSafe(repeated["again"]), "left").select(
        "doc_id", F.when(F.col("more"), F.xxhash64("raw")).otherwise(0).alias("copy"), "raw")


def _splitters(rows: DataFrame, width: int, range_bytes: int) -> Ranges:
    total, count = rows.agg(F.sum(F.octet_length("raw")), F.count(F.lit(1))).first()
    ranges = -(-(total or 0) // range_bytes)
    # Some anchors for every range, so the sample grows with the input as the ranges do.
    wanted = max(SAMPLED_DOCS, ranges * SAMPLED_PER_RANGE // SAMPLED_ANCHORS)
    every = max(1, (count or 0) // wanted)

    def sample(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["raw"]:
                for held in _pieces(iter([(0, 0, raw)]), width, WINDOW):
                    found = Records([held[0][3]], width)
                    if len(found.low):
                        pick = np.linspace(0, len(found.low) - 1, min(
                            SAMPLED_ANCHORS, len(found.low))).astype(int)
                        yield pd.DataFrame({"one": found.lead[0][pick].view(np.int64),
                                            "two": found.lead[1][pick].view(np.int64)})

    # SAMPLED_ANCHORS anchors from each text. The sample only places the boundaries; it decides no
    # result. A range costs 16 bytes a sampled anchor here and one splitter in every task.
    part = rows.where(F.pmod(F.xxhash64("doc_id", "copy"), F.lit(every)) == 0).select("raw")
    got = part.mapInPandas(sample, "one bigint, two bigint").limit(
        2 * wanted * SAMPLED_ANCHORS).toPandas()
    return Ranges(list(zip((x & (2**64 - 1) for x in got["one"].tolist()),
                           (x & (2**64 - 1) for x in got["two"].tolist()))), ranges)


def repeated_runs(rows: DataFrame, width: int = WIDTH, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, copy, start, end: runs of repeated bytes; runs of one document may overlap."""
    ranges = _splitters(rows, width, range_bytes)
    spread = ranges.count

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def stream() -> Iterator[tuple[int, int, bytes]]:
            for b in batches:
                yield from zip(b["doc_id"], b["copy"], b["raw"])

        nth = 0
        for held in _pieces(stream(), width, WINDOW):
            packed, known = _window_rows(held, ranges, width)
            if known:
                # Known runs ride along, dealt evenly over the ranges.
                nth += 1
                packed.append((-1 - (nth + known[0][0]) % spread,
                               np.array(known, "<i8").tobytes()))
            if packed:
                yield pd.DataFrame(packed, columns=["range", "blob"])

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "copy", "start", "end"]
        at, held = None, []

        def solved() -> Iterator[pd.DataFrame]:
            found = repeated_in_range(held, width) if held else []
            if found:
                yield pd.DataFrame(found, columns=columns)

        for b in batches:
            for number, blob in zip(b["range"], b["blob"]):
                if number < 0:
                    yield pd.DataFrame(np.frombuffer(blob, "<i8").reshape(-1, 4), columns=columns)
                    continue
                if number != at:
                    yield from solved()
                    held = []
                at = number
                held.append(blob)
        yield from solved()

    # A null id is larger than every other.
    packed = rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "copy", "raw").mapInPandas(read, "range int, blob binary")
    return packed.repartition("range").sortWithinPartitions("range").mapInPandas(
        solve, "doc_id bigint, copy bigint, start bigint, end bigint")


def _cut(raw: bytes, runs: np.ndarray) -> tuple[int, int, str]:
    """Removed bytes, removed runs and the digest of what is left."""
    if not len(runs):
        return 0, 0, hashlib.sha256(raw).hexdigest()
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    far = np.maximum.accumulate(runs[:, 1])
    new = np.ones(len(runs), bool)
    # Runs that touch leave no byte between them and are one.
    new[1:] = runs[1:, 0] > far[:-1]
    first = np.flatnonzero(new)
    start, end = runs[first, 0], far[np.append(first[1:], len(runs)) - 1]
    digest, at = hashlib.sha256(), 0
    for a, b in zip(start.tolist(), end.tolist()):
        digest.update(raw[at:a])
        at = b
    digest.update(raw[at:])
    return int((end - start).sum()), len(start), digest.hexdigest()


def remove_repeats(docs: DataFrame, width: int = WIDTH,
                   range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes, null is empty; texts under ``width`` bytes stay whole. Strings are
    judged on the input. Rows that share an id are no smaller than each other, so they do not
    remove each other's bytes; a null id is larger than every other id. Other columns are ignored;
    an empty table gives an empty table.
    """
    rows = _numbered(docs)
    runs = repeated_runs(rows, width, range_bytes)
    lists = runs.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    lists = Scratch(docs.sparkSession, "runs").write(lists.select(
        F.col("doc_id").alias("run_id"), F.col("copy").alias("run_copy"),
        F.expr("transform(runs, r -> r.start)").alias("starts"),
        F.expr("transform(runs, r -> r.end)").alias("ends")), "lists", free=True)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = [_cut(raw, np.stack([starts, ends], axis=1) if starts is not None
                         else np.empty((0, 2), np.int64))
                    for raw, starts, ends in zip(b["raw"], b["starts"], b["ends"])]
            yield pd.DataFrame({
                "doc_id": b["known_id"], "n_bytes": [len(r) for r in b["raw"]],
                "n_removed": [d[0] for d in done], "n_spans": [d[1] for d in done],
                "kept_sha256": [d[2] for d in done]})

    key = F.coalesce(F.col("doc_id"), F.lit(LAST))
    return rows.join(lists, (key == F.col("run_id")) & (F.col("copy") == F.col("run_copy")), "left") \
        .select(shown_id("doc_id").alias("known_id"), "raw", "starts", "ends").mapInPandas(
        finish, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, "
                "kept_sha256 string").withColumn("doc_id", hidden_id("doc_id"))
