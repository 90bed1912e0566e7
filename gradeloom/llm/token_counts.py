"""Token counts by a byte-level BPE tokenizer compiled to a finite-state transducer.

The outer transducer cuts a text into pre-tokens. It is a deterministic table over ten symbols:
the character's class, with the one or two characters of lookahead that the pattern needs folded
into the symbol. Texts are laid end to end and cut into chunks of equal length. Every chunk is
run from all states at once, which gives its state map; the maps are composed by a parallel
prefix scan, so each chunk learns its entry state, and a second run marks the transitions that
end a pre-token.

The inner transducer is a set of arcs, one per pre-token, annotated with the number of tokens
that it emits. Arcs are compiled when first met, by the tokenizer's own merges, and kept
in a table of bounded size. A document's count is the sum over its arcs; special tokens that stand in the
text emit one each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from gradeloom.llm.common import hidden_id, shown_id, worker_state

TOKEN_LIMIT = 1024
CHUNK = 256
WINDOW = 1 << 20
KEPT_ARCS = 300_000
LONG_ARC = 64
JOINED = 2000

# Symbols. "last": the final character of a run of white space with text after it.
(LETTER, NUMBER, OTHER, BLANK_LAST, BLANK, SPACE_LAST, SPACE, SUFFIX_1, SUFFIX_2, BREAK,
 PAD) = range(11)
# States: the kind of pre-token that the last character belongs to.
FRESH, WORD, DIGITS, SIGNS, LEADING_BLANK, SPACES, ONE_MORE, TWO_MORE = range(8)
# The pattern's suffixes after an apostrophe.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token starts here" by state and symbol, both flattened."""
    move = np.zeros((8, 11), np.uint8)
    starts = np.ones((8, 11), bool)
    for symbol, state in ((LETTER, WORD), (NUMBER, DIGITS), (OTHER, SIGNS),
                          (BLANK_LAST, LEADING_BLANK), (SPACE_LAST, FRESH), (BLANK, SPACES),
                          (SPACE, SPACES), (SUFFIX_1, ONE_MORE), (SUFFIX_2, TWO_MORE),
                          (BREAK, FRESH)):
        move[:, symbol] = state
    move[:, PAD], starts[:, PAD] = np.arange(8), False
    for state, symbol in ((WORD, LETTER), (DIGITS, NUMBER), (SIGNS, OTHER), (SPACES, BLANK),
                          (SPACES, SPACE), (LEADING_BLANK, LETTER), (LEADING_BLANK, NUMBER),
                          (LEADING_BLANK, OTHER)):
        starts[state, symbol] = False
    # Inside signs, or after a blank, an apostrophe is a sign whatever follows.
    for state in (SIGNS, LEADING_BLANK):
        for symbol in (SUFFIX_1, SUFFIX_2):
            move[state, symbol], starts[state, symbol] = SIGNS, False
    for state, then in ((ONE_MORE, FRESH), (TWO_MORE, ONE_MORE)):
        move[state, LETTER], starts[state, LETTER] = then, False
    return move.ravel(), starts.ravel()


def character_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER for every code point."""
    table = np.full(0x110000 + 1, OTHER, np.uint8)
    for low, high in ((0, 0xD800), (0xE000, 0x110000)):
        every = "".join(map(chr, range(low, high)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER),
                              (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[low + m.start():low + m.end()] = kind
    table[-1] = BREAK
    return table


class Transducer:
    """Counts the tokens of texts as the library does for a byte-level BPE file."""

    def __init__(self, path: str, chunk: int = CHUNK):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        kind = spec["pre_tokenizer"] or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("a byte-level BPE file without normalizer is needed")
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.library = Tokenizer.from_file(path)
        self.move, self.starts = transitions()
        self.classes = character_classes()
        self.arcs: dict[str, int] = {}
        self.chunk = chunk

    def symbols(self, points: np.ndarray) -> np.ndarray:
        """Symbol of every character; 0x110000 marks a break between texts."""
        kind = self.classes[points]
        space = kind == SPACE
        text_follows = np.zeros(len(kind), bool)
        text_follows[:-1] = ~space[1:] & (kind[1:] != BREAK)
        blank = points == 0x20
        out = kind.copy()
        out[space & ~blank & text_follows] = SPACE_LAST
        out[blank] = np.where(text_follows[blank], BLANK_LAST, BLANK)
        marks = np.flatnonzero(points == 0x27)
        if len(marks):
            after = np.append(points, [0x110000, 0x110000])
            for suffix in SUFFIXES:
                fits = np.ones(len(marks), bool)
                for i, c in enumerate(suffix):
                    fits &= after[marks + 1 + i] == ord(c)
                out[marks[fits]] = SUFFIX_1 if len(suffix) == 1 else SUFFIX_2
        return out

    def boundaries(self, symbols: np.ndarray) -> np.ndarray:
        """Positions at which a pre-token (or a break) starts."""
        n = -(-len(symbols) // self.chunk)
        grid = np.full(n * self.chunk, PAD, np.uint8)
        grid[:len(symbols)] = symbols
        steps = np.ascontiguousarray(grid.reshape(n, self.chunk).T)
        # State map of each chunk: where it leads from every entry state.
        maps = np.repeat(np.arange(8, dtype=np.uint8)[None, :], n, axis=0)
        for step in steps:
            maps = self.move[maps * np.uint8(11) + step[:, None]]
        # Inclusive prefix scan: maps[i] becomes the map of chunks 0 to i.
        reach = 1
        while reach < n:
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
            reach *= 2
        state = np.full(n, FRESH, np.uint8)
        state[1:] = maps[:-1, FRESH]
        found = np.empty((self.chunk, n), bool)
        for i, step in enumerate(steps):
            at = state * np.uint8(11) + step
            found[i] = self.starts[at]
            state = self.move[at]
        return np.flatnonzero(found.T.ravel()[:len(symbols)])

    def _compile(self, words: list[str]) -> None:
        """Add the arcs of new pre-tokens with the number of tokens that they emit."""
        # A blank and letters are one pre-token wherever they stand, so many go in one call.
        simple = [w for w in words if w[0] == " " and w[1:].isalpha()]
        for at in range(0, len(simple), JOINED):
            some = simple[at:at + JOINED]
            got = self.library.encode("".join(some), add_special_tokens=False)
            emitted = np.bincount(np.array(got.word_ids, np.int64))
            if len(emitted) == len(some):
                self.arcs.update(zip(some, emitted.tolist()))
        rest = [w for w in words if w not in self.arcs]
        for word, got in zip(rest, self.library.encode_batch(rest, add_special_tokens=False)):
            self.arcs[word] = len(got.ids)

    def _window(self, parts: list[str]) -> np.ndarray:
        """Tokens of each of some texts."""
        joined = "\0".join(parts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").copy()
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        breaks = np.cumsum(lengths + 1)[:-1] - 1
        points[breaks] = 0x110000
        starts = self.boundaries(self.symbols(points))
        ends = np.append(starts[1:], len(points))
        keep = points[starts] != 0x110000 if len(starts) else np.empty(0, bool)
        starts, ends = starts[keep], ends[keep]
        words = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        if len(self.arcs) > KEPT_ARCS:
            self.arcs.clear()
        known = self.arcs
        new = [w for w in dict.fromkeys(words) if w not in known]
        if new:
            self._compile(new)
        emitted = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for word in new:
            if len(word) > LONG_ARC:
                del known[word]
        owner = np.searchsorted(breaks, starts, "right")
        return np.bincount(owner, emitted, len(parts)).astype(np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        total = np.zeros(len(texts), np.int64)
        parts: list[str] = []
        owners: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if parts:
                np.add.at(total, owners, self._window(parts))
            parts.clear()
            owners.clear()
            size = 0

        for i, text in enumerate(texts):
            pieces = [text]
            if self.special and self.special.search(text):
                pieces = self.special.split(text)
                total[i] += len(pieces) - 1
            for piece in pieces:
                at = 0
                while at < len(piece):
                    end = len(piece)
                    if end - at > WINDOW:
                        # A blank after a word always starts a pre-token: a place to cut.
                        cut = regex.compile(r"(?<=\S) ").search(piece, at + WINDOW)
                        end = cut.start() if cut else end
                    parts.append(piece[at:end])
                    owners.append(i)
                    size += end - at
                    at = end
                    if size >= WINDOW:
                        flush()
        flush()
        return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    Null counts as an empty text: no bytes, no tokens. Ids may be null or repeat; every row has
    its own result. Other columns are ignored; an empty table gives an empty table. Texts are
    counted whole, in windows of about a million characters. Nothing is shuffled.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = worker_state(f"transducer:{tokenizer}", lambda: Transducer(tokenizer))
        for b in batches:
            texts = [t or "" for t in b["text"]]
            tokens = machine.count(texts)
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "n_bytes": [len(t.encode("utf-8")) for t in texts],
                "n_tokens": tokens, "over_limit": tokens > limit})

    return docs.select(shown_id("doc_id"), "text").mapInPandas(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    ).withColumn("doc_id", hidden_id("doc_id"))
