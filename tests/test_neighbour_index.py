import numpy as np
import pytest

from gradeloom.operators import neighbour_index as ni, neighbours as nb

from test_models import brute_force, listed, points


def found(df):
    got = {}
    for r in df.orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.neighbour)
    return got


@pytest.mark.parametrize("leaf_rows", [3, 40])
def test_tree_matches_brute_force(spark, monkeypatch, leaf_rows):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 20)
    monkeypatch.setattr(ni, "ROUTE_ROWS", 50)
    rng = np.random.default_rng(2)
    # A third of the training rows are copies of one vector, and small integers make many ties.
    vectors = [[3, 3, 3] if i % 3 == 0 else rng.integers(0, 6, 3).tolist() for i in range(300)]
    parts = ["a" if i % 4 else "b" for i in range(300)]
    train = points(spark, range(300), vectors, parts)
    queries = points(spark, range(1000, 1040), rng.integers(0, 6, (40, 3)).tolist(),
                     ["abc"[i % 3] for i in range(40)])
    want = brute_force(listed(queries), listed(train), 6)
    assert found(ni.tree_nearest(queries, train, 6, leaf_rows=leaf_rows)) == {
        q: near for q, near in want.items() if near}


def test_tree_without_rows_and_with_few(spark):
    train = points(spark, [1, 2], [[0.0], [5.0]])
    queries = points(spark, [10, 11], [[4.0], [4.0]])
    assert found(ni.tree_nearest(queries, train, 6)) == {10: [2, 1], 11: [2, 1]}
    assert found(ni.tree_nearest(queries, train.where("id > 2"), 6)) == {}
    assert found(ni.hashed_nearest(queries, train.where("id > 2"), 6)) == {}


def test_pairs_grow_far_slower_than_all_pairs(spark, folder):
    """Four times the rows and queries: all pairs grow sixteenfold, visited ones far less."""
    rng = np.random.default_rng(5)
    pairs, every = [], []
    for n in (2000, 8000):
        train = points(spark, range(n), rng.normal(size=(n, 3)).tolist())
        queries = points(spark, range(10**6, 10**6 + n // 10), rng.normal(size=(n // 10, 3)).tolist())
        ni.tree_nearest(queries, train, 6, count_pairs=pairs.append).count()
        every.append(n * n // 10)
    print("pairs visited", pairs, "of", every)
    assert pairs[1] < .25 * every[1] and pairs[1] < 9 * pairs[0]


def test_hashed_index_finds_neighbours_and_prunes(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 16)) * 4
    vectors = centres[rng.integers(0, 40, 1500)] + rng.normal(size=(1500, 16)) * .4
    train = points(spark, range(1500), vectors.tolist())
    queries = points(spark, range(5000, 5080), (vectors[:80] + .05).tolist())
    exact = nb.nearest(queries, train, 6)
    got = ni.hashed_nearest(queries, train, 6)
    assert ni.recall(exact, got).first().recall >= .9
    assert got.groupBy("query", "neighbour").count().where("count > 1").isEmpty()
    # Far fewer buckets in common find fewer.
    few = ni.hashed_nearest(queries, train, 6, tables=1, width=12, bucket=.05)
    assert ni.recall(exact, few).first().recall < .5
