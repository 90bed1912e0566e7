import hashlib
import random

import numpy as np
import pytest

from gradeloom.llm import suffix_dedup as sd

from .plain import awkward, rows_of


def brute(rows, width):
    """rows: (id, bytes); a null id is the largest."""
    key = [float("inf") if i is None else i for i, _ in rows]
    first = {}
    for k, (_, t) in zip(key, rows):
        for i in range(len(t) - width + 1):
            first[t[i:i + width]] = min(first.get(t[i:i + width], k), k)
    out = []
    for k, (i, t) in zip(key, rows):
        gone = bytearray(len(t))
        for p in range(len(t) - width + 1):
            if first[t[p:p + width]] < k:
                gone[p:p + width] = b"\1" * width
        spans = sum(1 for p in range(len(t)) if gone[p] and (not p or not gone[p - 1]))
        left = bytes(c for c, g in zip(t, gone) if not g)
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def texts(rng, n):
    base = ["".join(rng.choices("abcde fghé", k=rng.randrange(20, 300))) for _ in range(5)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(0, 4)):
            x = rng.choice(base)
            cut, at = rng.random(), rng.randrange(len(x))
            x = x[:at] + "#" + x[at + 1:] if cut < .3 else x[at:] if cut < .5 else x
            x = "a" * rng.randrange(5, 200) if cut > .9 else "xyz " * 40 if cut > .85 else x
            parts.append(x)
        out.append("".join(parts))
    return out


COLUMNS = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


@pytest.mark.parametrize("range_bytes", [1 << 20, 300])
def test_matches_brute_force(spark, monkeypatch, range_bytes):
    rows = texts(random.Random(range_bytes), 60) + [None, "", "short", "x" * 49, "x" * 50, "x" * 400]
    docs = awkward(spark, rows)
    got = rows_of(sd.remove_repeats(docs, range_bytes=range_bytes), *COLUMNS)
    assert got == brute([(i + 1, (t or "").encode()) for i, t in enumerate(rows)], 50)


def test_repeated_and_missing_ids(spark):
    a, b = "the same passage of more than fifty bytes in each of these texts", "another one " * 9
    rows = [(1, a), (1, a), (1, a + b), (None, a), (None, b), (2, "x" + b), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(sd.remove_repeats(docs), *COLUMNS) == brute(
        [(i, (t or "").encode()) for i, t in rows], 50)


def test_empty_table(spark):
    assert sd.remove_repeats(awkward(spark, ["a"]).where("doc_id > 4")).collect() == []


def test_windows_ranges_and_chunks_do_not_matter():
    rng = random.Random(9)
    for _ in range(25):
        width = rng.choice([50, 20])
        docs = list(zip(rng.sample(range(1000), 20), [t.encode() for t in texts(rng, 20)]))
        pairs = []
        for _, t in docs:
            found = sd.Records([t], width)
            if len(found.low):
                pairs += list(zip(found.lead[0].tolist(), found.lead[1].tolist()))
        ranges = sd.Ranges(rng.sample(pairs, min(len(pairs), 100)), rng.choice([1, 4, 30]))
        blobs, runs = {}, []
        for held in sd._pieces(((d, 0, t) for d, t in docs), width, rng.choice([60, 500, 10**6])):
            packed, known = sd._window_rows(held, ranges, width)
            runs += known
            for number, blob in packed:
                blobs.setdefault(number, []).append(blob)
        for held in blobs.values():
            runs += sd.repeated_in_range(held, width, rng.choice([60, 10**6]))
        of = {}
        for d, _, start, end in runs:
            of.setdefault(d, []).append((start, end))
        got = [(d, len(t), *sd._cut(t, np.array(of.get(d, []), np.int64).reshape(-1, 2)))
               for d, t in docs]
        assert sorted(got, key=repr) == brute(docs, width)


def test_many_thousand_ranges(spark):
    rng = np.random.default_rng(2)
    passage = bytes(rng.integers(97, 123, 300, dtype=np.uint8)).decode()
    texts = [bytes(rng.integers(97, 123, 4000, dtype=np.uint8)).decode() for _ in range(30)]
    texts = [t if i % 3 else t + passage for i, t in enumerate(texts)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    # A range of 20 bytes each: some 6,000 splitters.
    rows = sd._numbered(docs)
    assert sd._splitters(rows, 50, 20).count > 4096
    got = {r.doc_id: r.n_removed for r in sd.remove_repeats(docs, range_bytes=20).collect()}
    assert got == {i: 300 if i % 3 == 0 and i else 0 for i in range(30)}
