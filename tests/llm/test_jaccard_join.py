import random
import re

import numpy as np
import pytest

from gradeloom.llm import jaccard_join as jj

from .plain import Union, awkward, rows_of

COLUMNS = ["doc_id", "n_shingles", "component_id"]


def grams(text, n=4):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1))


def brute(rows, threshold=85):
    sets = [grams(t) for _, t in rows]
    groups = Union(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= threshold * len(a | sets[j]):
                groups.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            root = groups.find(i)
            least[root] = min(key, least.get(root, key))
    return sorted([(key, len(s), least.get(groups.find(i))) for i, ((key, _), s) in
                   enumerate(zip(rows, sets))], key=repr)


def family(rng, size, copies, vocabulary=2000):
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(size)]
    out = []
    for _ in range(copies):
        words = list(base)
        for _ in range(rng.randrange(size // 30 + 2)):
            words[rng.randrange(size)] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = []
    for _ in range(12):
        texts += family(rng, rng.randrange(5, 400), rng.randrange(1, 9))
    texts += [f"{passage} {t}" for t in family(rng, 40, 25)]
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(9)) for _ in range(25)]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("limit,ranged", [(1 << 21, 1 << 20), (2500, 700), (400, 3000)])
def test_matches_brute_force(spark, limit, ranged):
    rows = list(enumerate(corpus(limit), 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    want = brute(rows)
    assert 5 < len({w[2] for w in want}) < len(rows) - 15
    got = jj.similar_documents(docs, cluster_limit=limit, range_shingles=ranged)
    assert rows_of(got, *COLUMNS) == want


LONG = " ".join(f"word{i}" for i in range(250_000))
TEXTS = [None, "", " \t", "a", "A", "a b", "a b c", "a  b\tC", "a b c d", "a b c d e", LONG, LONG + " end",
         "É x y z", "é x y z", "\x85 x y z", "a b c d", "a b a b a b a b a b", "a b a b a b a b"]


def test_awkward_documents(spark):
    docs = awkward(spark, TEXTS).withColumnRenamed("rest", "cls").withColumnRenamed("runs", "root")
    assert rows_of(jj.similar_documents(docs), *COLUMNS) == brute(
        [(i + 1, t) for i, t in enumerate(TEXTS)])
    assert jj.similar_documents(docs.where("doc_id > 99")).collect() == []


def test_repeated_rows_and_missing_ids(spark):
    rows = [(None, "one two three four five"), (3, "one two three four five"), (3, "other words"),
            (3, "other words"), (None, "nobody else says this"), (None, "nobody else says this"), (2, None)]
    got = jj.similar_documents(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert rows_of(got, *COLUMNS) == brute(rows)


def test_given_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(jj.similar_documents(docs), *COLUMNS) == brute(rows)


@pytest.mark.parametrize("threshold", [30, 60, 85, 100])
def test_trie_links_equal_all_pairs(threshold):
    rng = np.random.default_rng(threshold)
    for _ in range(40):
        size, universe = rng.integers(2, 40), rng.integers(3, 60)
        sets = {np.sort(rng.choice(universe, rng.integers(1, universe), replace=False)).astype(
            np.uint64).tobytes() for _ in range(size)}
        sets = [np.frombuffer(s, np.uint64) for s in sorted(sets)]
        want, got = Union(range(len(sets))), Union(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                both = len(np.intersect1d(a, sets[j]))
                if 100 * both >= threshold * (len(a) + len(sets[j]) - both):
                    want.join(i, j)
        edges = jj.linked(sets, threshold)
        for i, j in edges:
            got.join(i, j)
        assert len(edges) < len(sets)
        assert [want.find(i) for i in range(len(sets))] == [got.find(i) for i in range(len(sets))]


def test_subtrees_without_hope_are_left():
    """Sets that share no rare shingle with the walker cost one node each, not their whole path."""
    common = np.arange(10**6, 10**6 + 30, dtype=np.uint64)
    sets = [np.sort(np.concatenate([common, np.arange(i * 100, i * 100 + 90, dtype=np.uint64)]))
            for i in range(50)]
    walked = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            walked.append(len(key))
            return super().__getitem__(key)

    root, _ = jj.build_trie([np.sort(s % np.uint64(10**6) + np.uint64(5000) * (s >= 10**6)).astype(np.int64)
                             for s in sets])
    held = np.zeros(10**5, bool).view(Seen)
    jj.reached(root, np.arange(90), held, [120] * 50, 85)
    assert len(walked) == len(root.children) == 50


def test_shingle_sets_of_windows_and_long_texts(monkeypatch):
    texts = [t.encode() for t in corpus(1)[:40]] + [b"", b"one", b"two words", b"A\x0bb\x0cC d"]
    want = [s.tolist() for s in jj.shingle_sets(iter(texts))]
    assert [len(s) for s in want] == [len(grams(t.decode())) for t in texts]
    monkeypatch.setattr(jj, "WINDOW", 50)
    assert [s.tolist() for s in jj.shingle_sets(iter(texts))] == want
