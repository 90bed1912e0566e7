import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gradeloom.llm.common import Scratch
from gradeloom.llm.components import components
from gradeloom.llm.simhash import (covering_masks, fingerprint, forest, near_duplicates, near_pairs,
                                   one_of_each)

from .plain import Union, awkward, rows_of


def plain_print(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64)
               if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: list of (id, fingerprint)."""
    groups = Union(i for i, _ in prints)
    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= 3:
                groups.join(i, j)
    return sorted((i, f"{x:016x}", groups.find(i)) for i, x in prints)


def test_fingerprint_is_spark_xxhash(spark):
    assert fingerprint("One") == spark.sql("SELECT xxhash64('one')").first()[0]


def test_documents_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = plain_components([(r.doc_id, plain_print(r.text)) for r in rows])
    assert rows_of(near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(
        want, key=repr)


def test_awkward_texts(spark):
    texts = [None, "", " \n", "one", "One", "one two", "one two three", "ONE  two\tthree",
             "É a b c", "é a b c", "w " * 60_000, "w " * 60_001, "a b c d"]
    docs = awkward(spark, texts)
    want = plain_components([(i + 1, plain_print(t)) for i, t in enumerate(texts)])
    assert rows_of(near_duplicates(docs), "doc_id", "fingerprint", "component_id") == sorted(
        want, key=repr)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in want})
    assert near_duplicates(docs.where("doc_id > 99")).collect() == []


def test_missing_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a"), (3, "a"), (3, "a"), (None, "b")],
                                 "doc_id bigint, text string")
    assert rows_of(near_duplicates(docs), "doc_id", "component_id") == sorted(
        [(None, 3), (3, 3), (3, 3), (None, None)], key=repr)


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_every_pattern_misses_a_mask(radius):
    masks = [m & (2**64 - 1) for m in covering_masks(radius)]
    rng = random.Random(radius)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(flips & m == 0 for m in masks)


def cloud(rng, n):
    """Fingerprints in chains and dense clusters around some centres, and far ones."""
    out = {rng.getrandbits(64) for _ in range(n // 3)}
    centres = [rng.getrandbits(64) for _ in range(3)]
    at = list(centres)
    while len(out) < n:
        c = rng.choice(at)
        for b in rng.sample(range(64), rng.choice([1, 2, 3, 3, 4])):
            c ^= 1 << b
        at.append(c)
        out.add(c)
    return sorted(out)


def test_forest_joins_what_all_pairs_join():
    prints = np.array(cloud(random.Random(1), 400), np.uint64)
    left, right = forest(prints.view(np.int64), 3)
    assert all((int(a) ^ int(b)).bit_count() <= 3
               for a, b in zip(left.view(np.uint64), right.view(np.uint64)))
    ours, all_pairs = Union(prints.tolist()), Union(prints.tolist())
    for a, b in zip(left.view(np.uint64).tolist(), right.view(np.uint64).tolist()):
        ours.join(a, b)
    for i, a in enumerate(prints.tolist()):
        for b in prints[:i].tolist():
            if (a ^ b).bit_count() <= 3:
                all_pairs.join(a, b)
    assert [ours.find(x) for x in prints.tolist()] == [all_pairs.find(x) for x in prints.tolist()]
    assert len(left) < len(prints)


@pytest.mark.parametrize("limit", [32768, 3])
def test_pairs_with_and_without_large_buckets(spark, limit):
    prints = cloud(random.Random(2), 200)
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    scratch = Scratch(spark, "test")
    edges = near_pairs(df, 3, scratch, bucket_limit=limit)
    assert edges.where(F.bit_count(F.expr("u ^ v")) > 3).count() == 0
    groups = Union(signed)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                groups.join(a, b)
    root = {r.node: r.root for r in components(edges, scratch).collect()}
    assert [root.get(x, x) for x in signed] == [groups.find(x) for x in signed]


def test_components_of_a_long_path(spark):
    edges = spark.range(299).selectExpr("id * 7 % 300 AS u", "(id + 1) * 7 % 300 AS v")
    got = components(edges, Scratch(spark, "test")).agg(
        F.count("*"), F.countDistinct("node"), F.max("root")).first()
    assert tuple(got) == (300, 300, 0)
