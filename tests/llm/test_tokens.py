import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from gradeloom.llm import token_counts as tc
from gradeloom.llm.packing import WordTokenizer, pack, plan
from gradeloom.llm.token_counts import Transducer, token_counts

from .plain import awkward, rows_of

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PARTS = st.sampled_from(["'", "s", "re", "'ll", "T'S", " ", "  ", "\n", "\t", "é", "É", "1", "²",
                         "a", "B", "!", ".", " ", "　", "\x1c", "\x85", "漢", "́",
                         "​", "İ", "Σ", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>",
                         "<|STARTOFTEXT|>", "_", "\0"])
TEXTS = [None, "", " ", "hello world", "It's  late.\n\nWe'll go", "<|endoftext|> x", "a" * 5000,
         "word, " * 9000, "É.é! É?", "1 22  333", "tail \n"]


@pytest.fixture(scope="module")
def counter():
    return Transducer(BYTES, chunk=5), Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def words():
    return WordTokenizer(WORDS), Tokenizer.from_file(WORDS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=25).map("".join), max_size=6))
def test_transducer_counts_as_the_library(counter, texts):
    machine, library = counter
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(texts).tolist() == want


@settings(max_examples=150, deadline=None)
@given(st.lists(PARTS, max_size=25).map("".join))
def test_word_ids_as_the_library(words, text):
    ours, library = words
    got = np.frombuffer(ours.ids(text), "<u4").tolist()
    assert got == library.encode(text, add_special_tokens=False).ids


def test_added_tokens_keep_their_case(words):
    ours, library = words
    for text in ["<|ENDOFTEXT|>", "Foo<|EndOfText|>bar", "Foo <|endoftext|> BAR", "A<|b C|>",
                 "<|startoftext|>X <|StartOfText|>x", "É<|ENDOFTEXT|>É", "x<|endoftext|>, Y."]:
        got = np.frombuffer(ours.ids(text), "<u4").tolist()
        assert got == library.encode(text, add_special_tokens=False).ids, text


def test_texts_are_cut_into_windows_without_effect(counter, monkeypatch):
    machine, library = counter
    monkeypatch.setattr(tc, "WINDOW", 50)
    texts = ["some words, here  and\n there's " * 20, "x" * 500, " a" * 300]
    assert machine.count(texts).tolist() == [
        len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_counts_of_awkward_documents(spark):
    library = Tokenizer.from_file(BYTES)
    want = []
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i + 1, len((t or "").encode()), n, n > 1024))
    docs = awkward(spark, TEXTS)
    columns = ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert rows_of(token_counts(docs, BYTES), *columns) == sorted(want, key=repr)
    assert token_counts(docs.where("doc_id > 99"), BYTES).collect() == []
    large = spark.createDataFrame([(2**62 + 1, "a"), (None, "a"), (2**62 + 1, None)],
                                  "doc_id bigint, text string")
    assert rows_of(token_counts(large, BYTES), "doc_id", "n_tokens") == sorted(
        [(2**62 + 1, 1), (None, 1), (2**62 + 1, 0)], key=repr)


def pieces(texts, capacity):
    library = Tokenizer.from_file(WORDS)
    for i, t in enumerate(texts):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at:at + capacity]
            yield i + 1, n, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def assert_packed(got, capacity):
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


@pytest.mark.parametrize("capacity", [4096, 7])
def test_packing_of_awkward_documents(spark, capacity):
    docs = awkward(spark, TEXTS + ["again"] * 40)
    got = pack(docs, WORDS, capacity).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(pieces(TEXTS + ["again"] * 40, capacity))
    used = assert_packed(got, capacity)
    assert used <= -(-sum(r.length for r in got) // capacity) * 1.1 + 1
    assert pack(docs.where("doc_id > 999"), WORDS, capacity).collect() == []


def test_repeated_and_missing_ids_are_packed(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "a"), (None, None), (None, "b")],
                                 "doc_id bigint, text string")
    got = pack(docs, WORDS).collect()
    assert len(got) == 4 and assert_packed(got, 4096) == 1


def best_possible_pairs(lengths, capacity):
    """Fewest bins for items above a third, by trying all numbers of smallest partners."""
    items, bins = sorted(lengths), 0
    while items:
        top = items.pop()
        fits = [x for x in items if x <= capacity - top]
        if fits:
            items.remove(fits[-1])
        bins += 1
    return bins


def test_plan_places_every_piece_once():
    rng = random.Random(4)
    for _ in range(200):
        counts = {rng.randrange(1, 61): rng.randrange(1, 40) for _ in range(rng.randrange(0, 25))}
        slots = plan(counts, 60)
        filled, placed = {}, {}
        for s in slots:
            assert s.first == placed.get(s.length, 0)
            placed[s.length] = s.first + s.copies * s.bins
            for i in range(s.bins):
                for k in range(s.copies):
                    filled.setdefault(s.bin + i, []).append((s.offset + k * s.length, s.length))
        assert placed == counts
        for items in filled.values():
            at = 0
            for offset, length in sorted(items):
                assert offset == at
                at += length
            assert at <= 60
        large = [n for n, c in counts.items() for _ in range(c) if 3 * n > 60]
        bound = max(-(-sum(n * c for n, c in counts.items()) // 60), best_possible_pairs(large, 60))
        assert bound <= len(filled) <= 1.15 * bound + 1
