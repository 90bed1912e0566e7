import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.topk_search import CELL_BYTES, grid, top_k, usable

from .plain import rows_of


def brute(rows, k, step):
    out = []
    for i, (q, v) in enumerate(rows):
        if q is None or q % step:
            continue
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(rows)
                         if j != i and c is not None))[:k]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("size, dims, high", [(150, 64, 9), (40, 5, 2), (3, 20, 5), (120, 33, 2**28)])
def test_matches_brute_force(spark, size, dims, high):
    rng = random.Random(size)
    rows = [(i, [rng.randrange(-high, high) for _ in range(dims)]) for i in range(size)]
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]  # a third are copies: ties
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    got = top_k(df, "vec_id % 10 = 0", k=7, block_rows=25, query_rows=4)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 7, 10)


def test_repeated_missing_and_short_vectors(spark):
    rows = [(0, [1, 2]), (0, [1, 2]), (None, [9, 9]), (3, [5]), (4, []), (5, [-1, -1, -1])]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    got = top_k(df, "vec_id % 10 = 0", k=20)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 20, 10)
    assert top_k(df.where("vec_id > 99"), "vec_id % 10 = 0").collect() == []


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0]), (2, None), (3, [None]), (4, [nan]), (5, [inf]), (6, [-inf]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>")
    assert rows_of(df.where(usable(F.col("v"))), "vec_id") == [(1,), (7,)]


def test_scores_beyond_64_bits_are_the_limits(spark):
    rows = [(0, [2**62, 2**62]), (1, [2**62, 2**62]), (2, [-2**62, -2**62]), (3, [1, 1]),
            (4, [2**40, 0])]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    got = top_k(df, "vec_id = 0", k=3)
    most = 2**63 - 1
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == [
        (0, 1, 1, most), (0, 2, 3, most), (0, 3, 4, most)]
    assert rows_of(top_k(df, "vec_id = 2", k=1), "vec_id", "score") == [(0, -most)]


def test_no_query_block_is_broadcast(spark):
    """The planner knows the size of the stored query blocks, not that of their copies."""
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-9, 9) for _ in range(16)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"
    got = top_k(df, "vec_id % 10 = 0", k=7, block_rows=25, query_rows=4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Join" not in plan
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 7, 10)


def test_numbers_of_every_width_in_one_table(spark):
    """Blocks are stored and summed in numbers of their own width."""
    rng = random.Random(7)
    rows = [(i, [rng.randrange(-h, h) for _ in range(20)])
            for i, h in enumerate(h for h in (9, 2**10, 2**24, 2**29) for _ in range(60))]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>").coalesce(1)
    got = top_k(df, "vec_id % 10 = 0", k=7, block_rows=30, query_rows=4)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == brute(rows, 7, 10)


def test_pairs_left_over_are_summed_alone(spark):
    """Most pairs drop out after the first groups, but for a few clusters; scores stay exact."""
    rng = np.random.default_rng(3)
    heads = rng.normal(size=(40, 64)) * np.linspace(9, 1, 64)
    points = np.rint(np.repeat(heads, 50, axis=0) + rng.normal(size=(2000, 64))).astype(int)
    rows = [(i, p.tolist()) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "vec_id bigint, values array<bigint>")
    got = top_k(df, "vec_id % 20 = 0", k=5, block_rows=500, query_rows=32)
    scores = points[::20] @ points.T
    scores[np.arange(100), np.arange(0, 2000, 20)] = -2**40
    best = [np.lexsort((np.arange(2000), -s))[:5] for s in scores]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(
        ((20 * q, n + 1, int(c), int(scores[q, c])) for q, b in enumerate(best)
         for n, c in enumerate(b)), key=repr)


def test_cells_are_bounded_and_enough_for_the_tasks():
    mb = 2 ** 20
    # One block of each kind, no query, and many tasks.
    assert grid(mb, 1, mb, 1, 200) == (1, 1) and grid(mb, 1, 0, 0, 200) == (1, 1)
    across, down = grid(300 * mb, 150, 15 * mb, 120, 100)
    assert 100 <= across * down <= 150 and 300 * mb / across <= CELL_BYTES
    # Copies of queries and of candidates weigh about the same.
    assert 1 / 3 < (15 * across) / (300 * down) < 3
    across, down = grid(10**6 * mb, 10**6, 10**5 * mb, 10**5, 100)
    assert 10**6 * mb / across <= CELL_BYTES and down == 1
