import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import neighbours as nb
from gradeloom.operators.models import assemble, fit_prompts, predict, weighted_train


def points(spark, ids, vectors, parts=None):
    parts = parts or ["all"] * len(ids)
    return spark.createDataFrame(
        [(p, i, [float(x) for x in v]) for p, i, v in zip(parts, ids, vectors)],
        "part string, id bigint, features array<double>")


def brute_force(queries, train, k):
    out = {}
    for part, q, v in queries:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), t)
                      for p, t, w in train if p == part)
        out[q] = [t for _, t in near[:k]]
    return out


def found(queries, train, k, **options):
    got = {}
    for r in nb.nearest(queries, train, k, **options).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r.neighbour)
    return got


def listed(df):
    return [(r.part, r.id, r.features) for r in df.collect()]


@pytest.mark.parametrize("pivots", [1, 5, 64])
def test_neighbours_match_brute_force(spark, monkeypatch, pivots):
    monkeypatch.setattr(nb, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(2)
    # A third of the training rows are copies of one vector, and small integers make many ties.
    vectors = [[3, 3, 3] if i % 3 == 0 else rng.integers(0, 6, 3).tolist() for i in range(300)]
    parts = ["a" if i % 4 else "b" for i in range(300)]
    train = points(spark, range(300), vectors, parts)
    queries = points(spark, range(1000, 1060), rng.integers(0, 6, (60, 3)).tolist(),
                     ["a" if i % 3 else "b" for i in range(60)])
    assert found(queries, train, 6, pivots=pivots) == brute_force(
        listed(queries), listed(train), 6)


def test_a_routed_query_is_one_row_and_one_product_finds_the_nearest(monkeypatch):
    """Routing must not make a row of features per query and cell; that filled a task's memory."""
    rng = np.random.default_rng(4)
    pivots = rng.normal(size=(256, 8))
    asked = pd.DataFrame({
        "part": "all", "query": range(3000), "features": list(rng.normal(size=(3000, 8)))})
    for name, values in (("cells", np.arange(256)), ("sizes", np.full(256, 40)),
                         ("radii", np.full(256, 3.0)), ("shelves", np.arange(256) // 30)):
        asked[name] = [values] * len(asked)
    routed = list(nb._route(pivots, 6)(iter([asked])))
    assert sum(map(len, routed)) == 3000 and max(map(len, routed)) <= nb.ROUTE_ROWS

    # Far from zero, with ties and copies, in several pieces.
    monkeypatch.setattr(nb, "HELD", 700)
    monkeypatch.setattr(nb, "PROBE", 16)
    left, right = (rng.integers(0, 4, (n, 3)) + 1e6 for n in (50, 300))
    at, to, d2 = nb._k_nearest(left, right, 6)
    exact = nb._squared(left, right)
    want = np.argsort(exact, axis=1, kind="stable")[:, :6]
    assert (to.reshape(50, 6) == want).all() and (at == np.repeat(np.arange(50), 6)).all()
    assert (d2 == exact[at, to]).all()


def test_shelves_and_blocks_of_both_sides(spark, monkeypatch):
    for name, rows in (("BLOCK_ROWS", 20), ("TRAIN_ROWS", 32), ("QUERY_ROWS", 16)):
        monkeypatch.setattr(nb, name, rows)
    rng = np.random.default_rng(3)
    train = points(spark, range(400), rng.normal(size=(400, 2)).tolist())
    queries = points(spark, range(1000, 1090), rng.normal(size=(90, 2)).tolist())
    assert found(queries, train, 6) == brute_force(listed(queries), listed(train), 6)


def test_fewer_training_rows_than_neighbours(spark):
    train = points(spark, [1, 2], [[0.0], [5.0]])
    queries = points(spark, [10], [[4.0]])
    assert found(queries, train, 6) == {10: [2, 1]}


def test_no_training_rows(spark):
    train = points(spark, [1], [[0.0]]).where("id > 1")
    assert found(points(spark, [10], [[4.0]]), train, 6) == {}


def test_far_apart_cells_are_skipped(spark):
    # Two clusters: a query next to one of them is sent to that cell only.
    train = points(spark, range(40), [[i % 20 + (1000 if i >= 20 else 0)] for i in range(40)])
    queries = points(spark, [100, 101], [[3.2], [1003.2]])
    got = found(queries, train, 3, pivots=40)
    assert got == {100: [3, 4, 2], 101: [23, 24, 22]}


def test_vote_ties_take_the_smallest_label(spark):
    near = spark.createDataFrame([(1, i) for i in range(6)], "query bigint, neighbour bigint")
    labels = spark.createDataFrame([(i, 5 if i % 2 else 2) for i in range(6)], "id bigint, label int")
    got = nb.vote(near, labels).first()
    assert (got.predicted, got.votes) == (2, 3)


@pytest.mark.parametrize("penalty", [None, 1.0])
def test_regression_separates_clusters_per_prompt(spark, penalty):
    rows = [(i, "pq"[i % 2], 1 + (i // 2) % 3, float(10 * ((i // 2) % 3) * (1 if i % 2 else -1))
             + i % 5 / 10) for i in range(120)]
    df = assemble(spark.createDataFrame(
        rows, "essay_id bigint, prompt_name string, score int, x double"), ["x"])
    models = fit_prompts(
        weighted_train(df, "prompt_name", "score", "exponential"), penalty_c=penalty, max_iter=200)
    assert sorted(models) == ["p", "q"]
    got = predict(models, df, ["essay_id", "score"], probabilities=True)
    assert got.where(F.col("score") != F.col("predicted")).count() == 0
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in got.collect())


def test_prompts_beyond_one_batch(spark, monkeypatch):
    from gradeloom.operators import models as md
    monkeypatch.setattr(md, "PARALLEL_FITS", 2)
    df = assemble(spark.createDataFrame(
        [(i, f"p{i % 5}", 1 + i // 5 % 2, float(i // 5 % 2)) for i in range(50)],
        "essay_id bigint, prompt_name string, score int, x double"), ["x"])
    train = weighted_train(df, "prompt_name", "score", "exponential")
    got = md.fit_and_predict(train, df, ["essay_id", "prompt_name", "score"], max_iter=50)
    assert got.count() == 50 and got.where("score != predicted").count() == 0


def test_absent_classes_are_never_predicted(spark):
    df = assemble(spark.createDataFrame(
        [(i, "p", 2 if i % 2 else 6, float(i % 2)) for i in range(40)],
        "essay_id bigint, prompt_name string, score int, x double"), ["x"])
    models = fit_prompts(weighted_train(df, "prompt_name", "score", "exponential"), max_iter=100)
    got = predict(models, df, ["essay_id"]).select("predicted").distinct().collect()
    assert {r.predicted for r in got} <= {2, 6}


@pytest.mark.parametrize("penalty", [0.5, 20.0])
def test_gradient_vanishes_at_the_penalised_fit(spark, penalty):
    """Sum of w (p - y) x over the rows plus coefficients / C is zero, and w (p - y) sums to zero."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(150, 2))
    y = 1 + (x[:, 0] + rng.normal(size=150) > 0) + (x[:, 1] > .8)
    df = assemble(spark.createDataFrame(
        [(i, "p", int(c), *map(float, v)) for i, (v, c) in enumerate(zip(x, y))],
        "essay_id bigint, prompt_name string, score int, a double, b double"), ["a", "b"])
    train = weighted_train(df, "prompt_name", "score", "exponential")
    (model,) = fit_prompts(train, penalty_c=penalty, max_iter=3000).values()
    got = predict({"p": model}, train, ["essay_id", "weight", "score"], probabilities=True).collect()
    got.sort(key=lambda r: r.essay_id)
    counts = np.bincount(y)
    assert np.allclose([r.weight for r in got], [np.exp(-counts[c] / 150) for c in y])
    p = np.array([r.probability for r in got])
    off = np.array([r.weight for r in got])[:, None] * (p - np.eye(p.shape[1])[y])
    coefficients = model.coefficientMatrix.toArray()
    assert np.abs(off.T @ x + coefficients / penalty).max() < .05
    assert np.abs(off.sum(axis=0)).max() < .05
    assert np.abs(coefficients).max() > .1


def test_one_pass_scores_as_the_models_do(spark):
    from pyspark.ml.functions import vector_to_array
    rng = np.random.default_rng(4)
    rows = [(i, "pq"[i % 2], int(c), float(v)) for i, (c, v) in enumerate(
        zip(rng.integers(1, 5, 80), rng.normal(size=80)))]
    df = assemble(spark.createDataFrame(
        rows, "essay_id bigint, prompt_name string, score int, x double"), ["x"])
    models = fit_prompts(weighted_train(df, "prompt_name", "score", "exponential"), max_iter=50)
    ours = {r.essay_id: r for r in predict(models, df, ["essay_id"], probabilities=True).collect()}
    for key, model in models.items():
        for r in model.transform(df.where(F.col("prompt_name") == key)).select(
                "essay_id", "prediction", vector_to_array("probability").alias("p")).collect():
            assert ours[r.essay_id].predicted == r.prediction
            assert np.allclose(ours[r.essay_id].probability, r.p)


def test_rows_without_a_model_keep_their_row(spark):
    from gradeloom.operators import models as md
    df = assemble(spark.createDataFrame(
        [(i, "p" if i < 20 else "only test", 1 + i % 2, float(i % 2)) for i in range(22)],
        "essay_id bigint, prompt_name string, score int, x double"), ["x"])
    train = weighted_train(df.where("essay_id < 20"), "prompt_name", "score", "exponential")
    got = md.fit_and_predict(train, df, ["essay_id"], max_iter=20)
    assert got.count() == 22 and got.where("predicted IS NULL").count() == 2


def test_a_fit_reads_its_prompt_only(spark):
    from gradeloom.operators import models as md
    df = spark.range(4000, numPartitions=4).selectExpr("concat('p', id % 5) AS prompt_name", "id AS x")
    parts = md.by_prompt(df, "prompt_name")
    one = parts.where(F.col(md.PART) == "p3")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in plan and one.count() == 800
    assert "Coalesce" not in plan
