import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import saved_models as sv
from gradeloom.operators.models import assemble, fit_coefficients, predict, fit_prompts, weighted_train


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(6)
    made = [(i, "pq"[i % 2], int(1 + (v + rng.normal() > 0) + 3 * (i % 2)), float(v), float(rng.normal()))
            for i, v in enumerate(rng.normal(size=160))]
    return spark.createDataFrame(made, "essay_id bigint, prompt_name string, score int, x double, y double")


@pytest.fixture(scope="module")
def train(rows):
    return weighted_train(assemble(rows, ["x", "y"]), "prompt_name", "score", "exponential")


@pytest.fixture(scope="module")
def path(spark, train, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('saved')}/set"
    # The first set is replaced by the second.
    for c in (0.01, 1.0):
        sv.save(fit_coefficients(train, penalty_c=c), sv.about_labels(train, "prompt_name", "score"),
                ["x", "y"], "prompt_name", path)
    return path


def test_another_session_predicts_the_same(spark, rows, train, path):
    loaded = sv.load(spark.newSession(), path)
    assert loaded.columns == ["x", "y"] and loaded.prompt == "prompt_name"
    ours = {r.essay_id: r for r in sv.grade(loaded, rows, ["essay_id", "x"], probabilities=True).collect()}
    models = fit_prompts(train, penalty_c=1.0)
    want = predict(models, train, ["essay_id", "x"], probabilities=True).collect()
    assert len(want) == len(ours) == 160
    for r in want:
        assert (ours[r.essay_id].predicted, ours[r.essay_id].x) == (r.predicted, r.x)
        assert np.allclose(ours[r.essay_id].probability, r.probability, atol=1e-5)


def test_what_models_know(spark, path):
    seen = {r.prompt: (r.rows, r.labels) for r in sv.load(spark, path).classes.collect()}
    assert seen == {"p": (80, [1, 2]), "q": (80, [4, 5])}


def test_unseen_labels_have_no_probability(spark, rows, path):
    for r in sv.grade(sv.load(spark, path), rows, ["prompt_name"], probabilities=True).collect():
        known = {"p": (1, 2), "q": (4, 5)}[r.prompt_name]
        assert all((p > 0) == (i in known) for i, p in enumerate(r.probability))
        assert abs(sum(r.probability) - 1) < 1e-9 and r.predicted in known


def test_unseen_prompts_and_null_features(spark, rows, path):
    new = spark.createDataFrame([(1, "p", 1.0, 0.0), (2, "other", 1.0, 0.0), (3, None, 1.0, 0.0),
                                 (4, "q", None, 0.0)],
                                "essay_id bigint, prompt_name string, x double, y double")
    loaded = sv.load(spark, path)
    got = {r.essay_id: r.predicted for r in sv.grade(loaded, new, ["essay_id"]).collect()}
    assert got[1] is not None and got[2] is got[3] is got[4] is None
    with pytest.raises(Exception, match="no model for prompt"):
        sv.grade(loaded, new, ["essay_id"], unseen="fail").collect()
    assert sv.grade(loaded, new.where("essay_id = 1"), ["essay_id"], unseen="fail").count() == 1
    with pytest.raises(ValueError, match="feature columns y"):
        sv.grade(loaded, new.drop("y"), ["essay_id"])


def test_pooled_model_stands_in(spark, rows, tmp_path):
    pooled = rows.union(rows.withColumn("prompt_name", F.lit(sv.POOLED)))
    train = weighted_train(assemble(pooled, ["x", "y"]), "prompt_name", "score", "exponential")
    sv.save(fit_coefficients(train, penalty_c=1.0), sv.about_labels(train, "prompt_name", "score"),
            ["x", "y"], "prompt_name", f"{tmp_path}/set")
    new = rows.where("essay_id < 20").withColumn("prompt_name", F.lit("other"))
    loaded = sv.load(spark, f"{tmp_path}/set")
    got = sv.grade(loaded, new, ["essay_id"], unseen="pooled").orderBy("essay_id").collect()
    same = sv.grade(loaded, new.withColumn("prompt_name", F.lit(sv.POOLED)), ["essay_id"]).orderBy(
        "essay_id").collect()
    assert got == same and all(r.predicted is not None for r in got)


def test_a_half_written_set_is_not_current(spark, rows, train, path):
    before = sv.load(spark, path).classes.collect()
    fit_coefficients(train, penalty_c=5.0).write.parquet(f"{path}/models/unfinished")
    assert sv.load(spark, path).classes.collect() == before
