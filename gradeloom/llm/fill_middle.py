"""Fill-in-middle transformation over content-defined chunks.

A rolling hash of the last bytes cuts every text into chunks, so passages that texts share fall into
equal chunks wherever they stand. A chunk's summary (tokens, code points, and whether it begins
and ends inside a run of letters) is computed once per worker and found again by the chunk's
bytes, which also verify it. Summaries of neighbours combine: a run of letters over a boundary
is one token, so the sum is one less. The combined counts name the chunk that holds a cut, and only
that chunk is looked at token by token. Nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import NO_ID, hidden_id, shown_id, worker_state

SENTINELS = ("<P>", "<S>", "<M>")
SEED = "1"
PLAIN_FROM = 90
SPM_UNDER = 20
# A chunk ends where this many bits of the rolling hash are zero: 2 KB on average.
CUT_BITS = 11
ROLLED = 16
LONGEST = 1 << 16
PIECE = 4 << 20
# The cache is emptied when its chunks reach so many bytes.
CACHED_BYTES = 32 << 20
OUT_BYTES = 16 << 20

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_GEAR = np.random.default_rng(11).integers(0, 2**32, 256, dtype=np.uint32)


class Summary(NamedTuple):
    """What a chunk adds to counts, and what its neighbours must know."""

    tokens: int
    chars: int
    opens: bool
    closes: bool


def cut_points(text: bytes, bits: int = CUT_BITS, longest: int = LONGEST) -> list[int]:
    """Ends of the chunks of ``text`` in bytes, never inside a character."""
    ends: list[int] = []
    start, size = 0, len(text)

    def forced(until: int) -> None:
        nonlocal start
        while until - start > longest:
            at = start + longest
            while at > start + longest - 4 and text[at] & 0xC0 == 0x80:
                at -= 1
            ends.append(at)
            start = at

    for low in range(0, size, PIECE):
        before = max(0, low - ROLLED + 1)
        raw = np.frombuffer(text, np.uint8, min(size, low + PIECE) - before, before)
        mixed = _GEAR[raw]
        for step in (1, 2, 4, 8):
            mixed[step:] += mixed[:-step] << np.uint32(step)
        for at in (np.flatnonzero(mixed >> np.uint32(32 - bits) == 0) + before + 1).tolist():
            if start < at < size and at > low and text[at] & 0xC0 != 0x80:
                forced(at)
                ends.append(at)
                start = at
    forced(size)
    if size:
        ends.append(size)
    return ends


def _starts(chunk: bytes, joined: bool) -> np.ndarray:
    """Places in ``chunk`` where a token starts; ``joined``: the text before ends with a letter."""
    raw = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[raw]
    start = raw & 0xC0 != 0x80
    start[1:] &= ~(letter[1:] & letter[:-1])
    if joined and letter[0]:
        start[0] = False
    return np.flatnonzero(start)


def summary(chunk: bytes) -> Summary:
    raw = np.frombuffer(chunk, np.uint8)
    letter = _LETTER[raw]
    chars = int(np.count_nonzero(raw & 0xC0 != 0x80))
    inside = int(np.count_nonzero(letter[1:] & letter[:-1]))
    return Summary(chars - inside, chars, bool(letter[0]), bool(letter[-1]))


class Summaries:
    """Summaries by chunk content, bounded in bytes."""

    def __init__(self, limit: int = CACHED_BYTES):
        self.limit, self.held, self.known, self.hits = limit, 0, {}, 0

    def of(self, chunk: bytes) -> Summary:
        found = self.known.get(chunk)
        if found is None:
            found = summary(chunk)
            if self.held + len(chunk) > self.limit:
                self.known, self.held = {}, 0
            self.known[chunk] = found
            self.held += len(chunk)
        else:
            self.hits += 1
        return found


class Counted:
    """A text whose tokens are counted by chunks."""

    def __init__(self, text: bytes, cache: Summaries, **cutting: int):
        ends = cut_points(text, **cutting)
        self.text, self.begins = text, [0, *ends[:-1]]
        self.chunks = [text[a:b] for a, b in zip(self.begins, ends)]
        found = [cache.of(c) for c in self.chunks]
        self.joined = [False, *(a.closes and b.opens for a, b in zip(found, found[1:]))]
        self.tokens = np.cumsum([s.tokens - j for s, j in zip(found, self.joined)], dtype=np.int64)
        self.chars = np.cumsum([s.chars for s in found], dtype=np.int64)
        self.n = int(self.tokens[-1]) if ends else 0

    def place(self, units: int) -> tuple[int, int]:
        """Bytes and code points before the token that follows the first ``units`` tokens."""
        if units >= self.n:
            return len(self.text), int(self.chars[-1]) if self.chunks else 0
        k = int(np.searchsorted(self.tokens, units, "right"))
        before = int(self.tokens[k - 1]) if k else 0
        at = int(_starts(self.chunks[k], self.joined[k])[units - before])
        head = np.frombuffer(self.chunks[k], np.uint8, at)
        return self.begins[k] + at, (int(self.chars[k - 1]) if k else 0) + int(
            np.count_nonzero(head & 0xC0 != 0x80))


def draws(seed: str, key: str) -> list[int]:
    """Four unsigned 32-bit integers of a document."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i:i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(text: bytes, key: str, cache: Summaries, seed: str = SEED,
                sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM,
                spm_under: int = SPM_UNDER) -> tuple:
    """n, form, code points of prefix and middle (None if plain), output."""
    marks = [s.encode() for s in sentinels]
    done = Counted(text, cache)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or h3 % 100 >= plain_from or any(m in text for m in marks):
        return done.n, "plain", None, None, text
    first, second = sorted((h1 % (done.n + 1), h2 % (done.n + 1)))
    (a, a_chars), (b, b_chars) = done.place(first), done.place(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = marks
    if h4 % 100 < spm_under:
        return done.n, "spm", a_chars, b_chars - a_chars, b"".join((s, suffix, p, prefix, m, middle))
    return done.n, "psm", a_chars, b_chars - a_chars, b"".join((p, prefix, s, suffix, m, middle))


def fill_in_middle(docs: DataFrame, seed: str = SEED,
                   sentinels: tuple[str, str, str] = SENTINELS, plain_from: int = PLAIN_FROM,
                   spm_under: int = SPM_UNDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n, form, prefix_chars, middle_chars, output.

    ``n`` tokens are runs of A-Z and a-z and single other code points. A null text counts as empty;
    empty texts and texts that hold a sentinel stay plain, whatever their length. A null doc_id
    draws as an empty key; rows that repeat are transformed alike. Other columns are ignored; an
    empty table gives an empty table.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = worker_state("fill-middle", Summaries)

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "n", "form", "prefix_chars",
                                              "middle_chars", "raw"])
            return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

        for b in batches:
            rows, size = [], 0
            for key, text in zip(b["doc_id"].tolist(), b["raw"]):
                rows.append((key, *transformed(text, "" if key == NO_ID else str(key), cache, seed,
                                               sentinels, plain_from, spm_under)))
                size += len(text)
                if size >= OUT_BYTES:
                    yield frame(rows)
                    rows, size = [], 0
            if rows:
                yield frame(rows)

    raw = F.coalesce("text", F.lit("")).cast("binary").alias("raw")
    return docs.select(shown_id("doc_id"), raw).mapInPandas(
        run, "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
             "raw binary").select(
        hidden_id("doc_id"), "n", "form", "prefix_chars", "middle_chars",
        F.col("raw").cast("string").alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``output`` was made from; sentinels occur in it once each."""
    p, s, m = sentinels

    def before(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, 1)

    def after(text: Column, mark: str) -> Column:
        return F.substring_index(text, mark, -1)

    middle = after(output, m)
    psm = F.concat(after(before(output, s), p), middle, before(after(output, s), m))
    spm = F.concat(before(after(output, p), m), middle, after(before(output, p), s))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
