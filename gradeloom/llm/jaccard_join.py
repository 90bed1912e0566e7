"""N-gram Jaccard join over prefix trees.

1. Documents become sets of 64-bit shingle hashes, computed for a window of texts at once. Equal
   sets are one class from then on.
2. A set can only be linked if enough of its shingles occur in another set as well. Whole shingle
   sets are judged on that without moving a row per shingle: a window packs short keys of its
   shingles by range of the hash, a range answers which keys two sets share, and the answers are
   summed per window. Keys can collide, which only lets a set pass that the next step drops.
3. Of the sets that pass, shingles get one global order, rarest first. Two linked sets share a
   shingle among the first n - ceil(threshold * n) + 1 of both, so stars over those shingles join
   all candidates into clusters; a cluster is far smaller than what shares a common passage.
4. A cluster's sets are stored once in a trie in that order. A set walks the trie: its overlap with
   a path is counted once for all sets below, and a subtree is left when neither the rest of the
   set nor the longest rest below can lift the overlap to what the smallest set there needs. Sets that
   were reached leave the trie, so a crowd of near copies costs little more than one walk.
5. A cluster beyond ``cluster_limit`` shingles is dealt into parts by hash, whose links contract it.
   Shingles that then lie within one component need no further look, which breaks the cluster up;
   after ``ROUNDS`` of that what is left is searched exactly, every pair of parts in a task.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.llm.common import Scratch, hidden_id, shown_id
from gradeloom.llm.components import components

SHINGLE_WORDS = 4
THRESHOLD = 85
# Texts hashed at a time, shingles packed at a time, and shingles of a range.
WINDOW = 2 << 20
WINDOW_SHINGLES = 1 << 20
WINDOW_DOCS = 60_000
RANGE_SHINGLES = 1 << 20
KEY_BITS = 24
# Shingles of a cluster's sets that one task holds.
CLUSTER_LIMIT = 1 << 21
ROUNDS = 3

_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DRAW = np.random.default_rng(12)
_BYTES = _DRAW.integers(1, 2**64, 256, dtype=np.uint64)
_PLACES = _DRAW.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_ODD = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_ODD, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_ODD, -k, 1 << 64))])
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of ``raw``, which is lower-cased."""
    flat = np.frombuffer(raw, np.uint8)
    blank = _SPACE[flat]
    edge = np.diff(blank, prepend=True, append=True)
    at = np.flatnonzero(edge)
    begin, end = at[::2], at[1::2]
    if not len(begin):
        return np.empty(0, np.uint64), begin
    up, down = _POWERS.of(len(flat) + 1)
    total = np.cumsum(_BYTES[flat] * up[:len(flat)], dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    value = (total[end - 1] - before) * down[begin]
    return _mixed(value + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), begin


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of one long text, piece by piece; pieces end at white space."""
    out, at = [], 0
    while at < len(text):
        gap = _GAP.search(text, at + WINDOW)
        end = gap.start() if gap else len(text)
        out.append(word_hashes(text[at:end])[0])
        at = end
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _set_of(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return words
    if len(words) < n:
        # Shorter texts are one shingle of their own length, which no longer one equals.
        mixed = (words * _PLACES[:len(words)]).sum(dtype=np.uint64) + np.uint64(len(words))
        return _mixed(np.array([mixed], np.uint64))
    size = len(words) - n + 1
    mixed = np.full(size, n, np.uint64)
    for j in range(n):
        mixed += words[j:j + size] * _PLACES[j]
    mixed = np.sort(_mixed(mixed))
    new = np.ones(size, bool)
    new[1:] = mixed[1:] != mixed[:-1]
    return mixed[new]


def shingle_sets(texts: Iterator[bytes], n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """One sorted array of distinct shingle hashes per text, in order."""
    def solve(held: list[bytes]) -> Iterator[np.ndarray]:
        if len(held) == 1 and len(held[0]) > WINDOW:
            yield _set_of(_long_words(held[0].lower()), n)
            return
        words, at = word_hashes(b"\n".join(held).lower())
        ends = np.searchsorted(at, np.cumsum([len(t) + 1 for t in held]), "left")
        first = 0
        for last in ends.tolist():
            yield _set_of(words[first:last], n)
            first = last

    held, size = [], 0
    for text in texts:
        if held and size + len(text) > WINDOW:
            yield from solve(held)
            held, size = [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield from solve(held)


def digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _each_set(batches: Iterator[pd.DataFrame], n: int) -> Iterator[tuple]:
    """(doc_id, set) of every row."""
    for b in batches:
        yield from zip(b["doc_id"].tolist(), shingle_sets(iter(b["raw"]), n))


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(shown_id("doc_id"),
                       F.coalesce("text", F.lit("")).cast("binary").alias("raw"))


def set_digests(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and set (digest, null if empty) of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(len(s), digest(s) if len(s) else None) for s in shingle_sets(iter(b["raw"]), n)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_shingles": [f[0] for f in found],
                                "set": [f[1] for f in found]})

    return _raw(docs).mapInPandas(run, "doc_id bigint, n_shingles bigint, set binary").withColumn(
        "doc_id", hidden_id("doc_id"))


# Step 2: which sets share enough of their shingles.


def _range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def _window_rows(window: int, sets: list[np.ndarray], ranges: int) -> Iterator[tuple]:
    """Rows (range, window, kind, blob) of one window of different sets.

    Shingles that the window itself repeats are shared for sure: they are counted here and sent
    once, without owners, for other windows to meet.
    """
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    same = flat[order][1:] == flat[order][:-1]
    twice = np.zeros(len(flat), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    first = np.zeros(len(flat), bool)
    first[order[1:]] = ~same
    first[order[:1]] = True
    shared = np.bincount(owner[twice], minlength=len(sets))
    head = np.concatenate([size, shared]).astype("<i8").tobytes()
    yield -1 - window % ranges, window, 0, head + b"".join(digest(s) for s in sets)
    mask = np.uint64((1 << KEY_BITS) - 1)
    for kind, chosen in ((1, np.flatnonzero(~twice)), (2, np.flatnonzero(twice & first))):
        where = _range_of(flat[chosen], ranges)
        # By range, and by owner within it.
        chosen = chosen[np.argsort(where, kind="stable")]
        where = np.sort(where)
        keys = (flat[chosen] & mask).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        cut = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(where)]):
            if a < b:
                blob = keys[a:b].tobytes()
                if kind == 1:
                    blob += owner[chosen[a:b]].astype("<u2").tobytes()
                yield int(where[a]), window, kind, blob


def _keys(blob: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :3] = np.frombuffer(blob, np.uint8, 3 * n).reshape(n, 3)
    return wide.view("<u4").ravel()


def _shared_in_range(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, int, bytes]]:
    """(window, kind, owners of shared keys) of one range."""
    owned = [(w, blob, len(blob) // 5) for w, kind, blob in rows if kind == 1]
    known = [_keys(blob, len(blob) // 3) for _, kind, blob in rows if kind == 2]
    keys = [_keys(blob, n) for _, blob, n in owned]
    if not keys:
        return
    every = np.sort(np.concatenate(keys))
    shared = np.zeros(1 << KEY_BITS, bool)
    shared[every[1:][every[1:] == every[:-1]]] = True
    for some in known:
        shared[some] = True
    for (window, blob, n), own in zip(owned, keys):
        hit = shared[own]
        if hit.any():
            yield window, 1, np.frombuffer(blob, "<u2", n, 3 * n)[hit].tobytes()


def _grouped(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """Whole groups of rows that arrive sorted by ``key``."""
    held: list[pd.DataFrame] = []
    for b in batches:
        values = b[key].to_numpy()
        cut = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(b)]
        for a, z in zip(cut, cut[1:]):
            if a == z:
                continue
            if held and held[0][key].iloc[0] != values[a]:
                yield held[0][key].iloc[0], pd.concat(held)
                held = []
            held.append(b.iloc[a:z])
    if held:
        yield held[0][key].iloc[0], pd.concat(held)


def possible_sets(docs: DataFrame, n: int, threshold: int, shingles: int,
                  range_shingles: int = RANGE_SHINGLES) -> DataFrame:
    """Digests (``set``) of all sets that may be linked; the number of ranges follows ``shingles``."""
    ranges = max(1, -(-shingles // range_shingles))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nth, held, seen, size = 0, [], set(), 0
        task = TaskContext.get().partitionId()

        def flush() -> pd.DataFrame:
            return pd.DataFrame(_window_rows(task << 32 | nth, held, ranges),
                                columns=["range", "window", "kind", "blob"])

        for _, found in _each_set(batches, n):
            key = digest(found)
            if not len(found) or key in seen:
                continue
            held.append(found)
            seen.add(key)
            size += len(found)
            if size >= WINDOW_SHINGLES or len(held) >= WINDOW_DOCS:
                yield flush()
                nth, held, seen, size = nth + 1, [], set(), 0
        if held:
            yield flush()

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, rows in _grouped(batches, "range"):
            if number < 0:
                yield rows[["window", "kind", "blob"]]
                continue
            out = list(_shared_in_range(list(zip(rows["window"], rows["kind"], rows["blob"]))))
            if out:
                yield pd.DataFrame(out, columns=["window", "kind", "blob"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _grouped(batches, "window"):
            (head,) = rows.loc[rows["kind"] == 0, "blob"]
            count = len(head) // 32
            size, shared = np.frombuffer(head, "<i8", 2 * count).reshape(2, count)
            owners = np.frombuffer(b"".join(rows.loc[rows["kind"] == 1, "blob"]), "<u2")
            shared = shared + np.bincount(owners, minlength=count)
            kept = np.flatnonzero(100 * shared >= threshold * size)
            if len(kept):
                yield pd.DataFrame({"set": [head[16 * count + 16 * i:16 * count + 16 * i + 16]
                                            for i in kept.tolist()]})

    packed = _raw(docs).mapInPandas(pack, "range bigint, window bigint, kind int, blob binary")
    answers = packed.repartition("range").sortWithinPartitions("range").mapInPandas(
        meet, "window bigint, kind int, blob binary")
    return answers.repartition("window").sortWithinPartitions("window").mapInPandas(
        judge, "set binary").distinct()


# Steps 3 to 5: clusters of candidates and the trie join inside them.


class Node:
    """A run of shingles that all sets below share, then children by their next shingle."""

    __slots__ = ("run", "last", "depth", "children", "members", "alive", "least", "most", "up")

    def __init__(self, run: np.ndarray, depth: int, up: Node | None):
        self.run, self.depth, self.up = run, depth, up
        self.last = int(run[-1]) if len(run) else -1
        self.children: list[Node] = []
        self.members: list[int] = []
        self.alive, self.least, self.most = 0, 1 << 62, 0


def build_trie(sets: list[np.ndarray]) -> tuple[Node, list[Node]]:
    """The root, and the node at which each set ends. Sets are sorted and in one order."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
    root = Node(np.empty(0, np.int64), 0, None)
    ends: list[Node] = [root] * len(sets)
    stack: list[tuple[int, int, int, Node]] = [(0, len(order), 0, root)]
    while stack:
        low, high, depth, up = stack.pop()
        while low < high:
            first = sets[order[low]]
            if len(first) == depth:
                up.members.append(order[low])
                ends[order[low]] = up
                low += 1
                continue
            # Sets with the same next shingle stand together.
            a, b = low + 1, high
            while a < b:
                mid = (a + b) // 2
                if sets[order[mid]][depth] == first[depth]:
                    a = mid + 1
                else:
                    b = mid
            last = sets[order[a - 1]]
            size = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:size] != last[depth:size])
            common = depth + int(differ[0]) if len(differ) else size
            node = Node(first[depth:common].astype(np.int64), common, up)
            up.children.append(node)
            stack.append((low, a, common, node))
            low = a
    for i, node in enumerate(ends):
        size = len(sets[i])
        while node is not None:
            node.alive += 1
            node.least, node.most = min(node.least, size), max(node.most, size)
            node = node.up
    return root, ends


def needed(threshold: int, total: int) -> int:
    """Smallest overlap of two sets of ``total`` shingles together that links them."""
    return -(-threshold * total // (100 + threshold))


def reached(root: Node, mine: np.ndarray, held: np.ndarray, sizes: list[int],
            threshold: int) -> list[int]:
    """Sets in the trie that are linked to ``mine``; ``held`` marks its shingles."""
    out: list[int] = []
    size, places = len(mine), mine.tolist()
    stack = [(root, 0)]
    while stack:
        node, overlap = stack.pop()
        if not node.alive:
            continue
        if len(node.run):
            overlap += int(np.count_nonzero(held[node.run]))
            rest = min(size - bisect_right(places, node.last), node.most - node.depth)
            if overlap + rest < needed(threshold, size + node.least):
                continue
        out += [i for i in node.members if overlap >= needed(threshold, size + sizes[i])]
        stack += [(child, overlap) for child in node.children]
    return out


def linked(sets: list[np.ndarray], threshold: int) -> list[tuple[int, int]]:
    """Edges of spanning trees over all linked pairs of ``sets`` (distinct, none empty)."""
    shingles, flat, uses = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(shingles), np.int64)
    rank[np.argsort(uses, kind="stable")] = np.arange(len(shingles))
    ordered = [np.sort(s) for s in np.split(rank[flat], np.cumsum([len(s) for s in sets])[:-1])]
    root, ends = build_trie(ordered)
    sizes = [len(s) for s in sets]
    held = np.zeros(len(shingles), bool)
    gone = [False] * len(sets)

    def leave(i: int) -> None:
        gone[i] = True
        node = ends[i]
        if i in node.members:
            node.members.remove(i)
        while node is not None:
            node.alive -= 1
            node = node.up

    edges = []
    for start in range(len(sets)):
        if gone[start]:
            continue
        leave(start)
        open_ = [start]
        while open_:
            i = open_.pop()
            held[ordered[i]] = True
            for j in reached(root, ordered[i], held, sizes, threshold):
                leave(j)
                edges.append((i, j))
                open_.append(j)
            held[ordered[i]] = False
    return edges


def _join_parts(rows: DataFrame, threshold: int) -> DataFrame:
    """Edges (u, v) of classes that meet in a part. ``rows``: part, cls, shingles (8 bytes each)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, group in _grouped(batches, "part"):
            group = group.drop_duplicates("cls").sort_values("cls")
            if len(group) < 2:
                continue
            names = group["cls"].to_numpy()
            found = linked([np.frombuffer(b, np.uint64) for b in group["shingles"]], threshold)
            if found:
                pairs = np.array(found)
                yield pd.DataFrame({"u": names[pairs[:, 0]], "v": names[pairs[:, 1]]})

    return rows.repartition("part").sortWithinPartitions("part").mapInPandas(
        run, "u bigint, v bigint")


def _prefixes(sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """cls, n, shingle: the shared shingles among those by which a set must meet a linked one."""
    flat = sets.select("cls", "n", F.explode("shingles").alias("shingle"))
    shared = scratch.write(flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses")).where(
        "uses > 1"), "uses")
    rows = flat.join(shared, "shingle")
    # A window sees the shingles of one document; those of no other set come before them.
    place = F.row_number().over(Window.partitionBy("cls").orderBy("uses", "shingle"))
    total = F.count(F.lit(1)).over(Window.partitionBy("cls"))
    need = F.ceil(F.col("n") * threshold / 100)
    return scratch.write(rows.select("cls", "n", "shingle", place.alias("place"), total.alias("total"))
                         .where(F.col("total") >= need)
                         .where(F.col("n") - F.col("total") + F.col("place") <= F.col("n") - need + 1)
                         .select("cls", "shingle"), "prefixes")


def _clusters(prefixes: DataFrame, roots: DataFrame | None, scratch: Scratch) -> DataFrame:
    """cls, cluster: classes that share a shingle whose sets are not all in one component yet."""
    rows = prefixes
    if roots is not None:
        rows = rows.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", "shingle", F.coalesce("root", "cls").alias("root"))
    else:
        rows = rows.withColumn("root", F.col("cls"))
    heads = scratch.write(rows.groupBy("shingle").agg(
        F.min("cls").alias("head"), F.min("root").alias("a"), F.max("root").alias("b")).where(
        "a != b").select("shingle", "head"), "heads")
    stars = rows.join(heads, "shingle").where("cls != head").select(
        F.col("head").alias("u"), F.col("cls").alias("v"))
    return components(stars, scratch).select(F.col("node").alias("cls"), F.col("root").alias("cluster"))


def _edges(sets: DataFrame, threshold: int, scratch: Scratch, cluster_limit: int) -> DataFrame:
    """Edges (u, v) that connect everything linked. ``sets``: cls, n, shingles (bigint array)."""
    prefixes = _prefixes(sets, threshold, scratch)
    packed = sets.select("cls", "n", _packed(F.col("shingles")).alias("shingles"))
    edges, roots = None, None
    for nth in range(ROUNDS + 1):
        clusters = scratch.write(_clusters(prefixes, roots, scratch), f"clusters{nth}")
        rows = packed.join(clusters, "cls")
        load = scratch.write(rows.groupBy("cluster").agg(F.sum("n").alias("load")).withColumn(
            "parts", F.ceil(F.col("load") / cluster_limit).cast("int")), f"load{nth}")
        rows = rows.join(load, "cluster").withColumn(
            "own", F.pmod(F.xxhash64("cls", F.lit(nth)), F.col("parts")).cast("int"))
        whole = load.where("parts > 1").isEmpty()
        if nth == ROUNDS and not whole:
            # Every pair of parts meets once: a part and all parts from it on.
            other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
            rows = rows.select("*", other).withColumn("low", F.least("own", "other")).withColumn(
                "high", F.greatest("own", "other"))
        else:
            rows = rows.withColumn("low", F.col("own")).withColumn("high", F.col("own"))
        rows = rows.select(F.xxhash64("cluster", "low", "high").alias("part"), "cls", "shingles")
        new = scratch.write(_join_parts(rows, threshold), f"edges{nth}")
        edges = new if edges is None else scratch.write(edges.union(new), f"all{nth}")
        if whole:
            break
        roots = scratch.write(components(edges, scratch), f"roots{nth}")
    return edges


def _packed(shingles: Column) -> Column:
    """An array of bigint as bytes in the order of the machine."""
    @F.pandas_udf("binary")
    def pack(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda a: np.asarray(a, np.int64).tobytes())

    return pack(shingles)


def similar_documents(docs: DataFrame, words: int = SHINGLE_WORDS, threshold: int = THRESHOLD,
                      cluster_limit: int = CLUSTER_LIMIT,
                      range_shingles: int = RANGE_SHINGLES) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Two documents are linked when 100 * intersection >= ``threshold`` * union of their sets of
    ``words``-word shingles; A-Z is lower-cased, words end at ASCII white space, a shorter text is one
    shingle. component_id is the smallest doc_id that a document reaches, its own included. A
    null or wordless text has an empty set and is linked with nothing, not even its like. Rows
    that repeat an id keep one row each. A null doc_id names a component only if nothing else is in
    it (then component_id is null). Long texts are read whole. Other columns are ignored; an empty
    table gives an empty table. Shingles are compared by 64-bit hashes.
    """
    if not 0 < threshold <= 100:
        raise ValueError("threshold must be 1 to 100")
    scratch = Scratch(docs.sparkSession, "jaccard")
    rows = scratch.write(set_digests(docs, words), "rows")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    possible = scratch.write(possible_sets(docs, words, threshold, total, range_shingles), "possible")
    classes = scratch.write(rows.join(possible, "set", "left_semi").groupBy("set").agg(
        F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n")).withColumn(
        "cls", F.monotonically_increasing_id()), "classes")

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for _, found in _each_set(batches, words):
            if len(found):
                held.append((digest(found), found.view(np.int64)))
                size += len(found)
            if size >= WINDOW_SHINGLES:
                yield pd.DataFrame(held, columns=["set", "shingles"])
                held, size = [], 0
        if held:
            yield pd.DataFrame(held, columns=["set", "shingles"])

    # One text of each class; ids that repeat bring more, which their digests sort out.
    one = docs.join(classes.select(F.col("doc_id").alias("_one")),
                    F.col("doc_id").eqNullSafe(F.col("_one")), "left_semi").select("doc_id", "text")
    sets = scratch.write(_raw(one).mapInPandas(shingles, "set binary, shingles array<bigint>").join(
        classes, "set").select("cls", "n", "shingles").dropDuplicates(["cls"]), "sets")

    roots = components(_edges(sets, threshold, scratch, cluster_limit), scratch)
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls").select("set", "root")
    members = scratch.write(rows.where("set is not null").join(named, "set", "left").select(
        "doc_id", "n_shingles", F.coalesce(F.col("root").cast("string"), F.hex("set")).alias("group")),
        "members")
    least = members.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    alone = rows.where("set is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return members.join(least, "group").select("doc_id", "n_shingles", "component_id").union(alone)
