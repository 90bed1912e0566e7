import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.llm.mixing import mixed, soft_mix

from .plain import awkward

TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}
KEYS = ["doc_id", "text", "lang", "source"]


def labels(spark, folder):
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    return spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", domain.alias("domain"))


@pytest.fixture(scope="module")
def fitted(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = soft_mix(docs, labels(spark, folder), TARGETS).collect()
    return (np.array([r.tokens for r in rows], float), np.array([r.posteriors for r in rows]),
            np.array([r.rate for r in rows]), rows)


def test_expected_tokens_match_the_targets(fitted):
    n, p, rate, _ = fitted
    assert (rate >= 0).all()
    got = (n * rate) @ p / n.sum()
    assert np.abs(got - [.90, .08, .02]).max() < .005


def test_posteriors_are_distributions_that_follow_the_labels(spark, folder, fitted):
    _, p, _, rows = fitted
    assert np.abs(p.sum(axis=1) - 1).max() < .001
    known = {r.doc_id: r.domain for r in labels(spark, folder).collect()}
    hits = [sorted(TARGETS)[int(np.argmax(r.posteriors))] == known[r.doc_id]
            for r in rows if r.doc_id in known]
    assert np.mean(hits) > .85


def test_rates_meet_the_optimality_conditions(fitted):
    """Some multipliers explain all rates: r = max(0, 1 - p.m)."""
    n, p, rate, _ = fitted
    active = rate > 1e-6
    m, *_ = np.linalg.lstsq(p[active], 1 - rate[active], rcond=None)
    assert np.abs(1 - p[active] @ m - rate[active]).max() < .02
    assert (1 - p[~active] @ m < .05).all()


def test_rates_follow_the_posterior_only(fitted):
    _, p, rate, _ = fitted
    by = {}
    for key, r in zip(map(tuple, p), rate):
        assert by.setdefault(key, r) == r


def test_mix_draws_by_rate_and_keeps_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("_rate", F.lit("own"))
    got = mixed(docs, labels(spark, folder), TARGETS)
    assert got.columns == docs.columns and {r._rate for r in got.select("_rate").collect()} == {"own"}
    rate = {r.doc_id: r.rate for r in soft_mix(docs, labels(spark, folder), TARGETS).collect()}
    times = {r.doc_id: r["count"] for r in got.groupBy("doc_id").count().collect()}
    assert all(np.floor(x) <= times.get(k, 0) <= np.floor(x) + 1 for k, x in rate.items())
    assert abs(sum(times.values()) - sum(rate.values())) < 5 * len(rate) ** .5


def test_a_removed_domain_bends_no_rate(spark, folder):
    """Without its documents the others meet their targets, with posteriors of all labels."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    known = labels(spark, folder)
    left = docs.join(known.where("domain = 'toxic'"), "doc_id", "left_anti")
    targets = {"high": 0.90, "low": 0.08}
    rows = soft_mix(left, known, targets, removed=["toxic"], examples=docs).collect()
    n, p = np.array([r.tokens for r in rows], float), np.array([r.posteriors for r in rows])
    rate = np.array([r.rate for r in rows])
    got = (n * rate) @ p[:, :2] / (n @ p[:, :2].sum(axis=1))
    assert np.abs(got - np.array([.90, .08]) / .98).max() < .005
    assert (rate[p[:, 2] >= p.max(axis=1)] <= 1).all() and rate.max() < 3


def test_awkward_documents(spark):
    docs = awkward(spark, [None, "", "w " * 60_000, "a b", "a b"])
    none = spark.createDataFrame([], "doc_id bigint, domain string")
    rows = soft_mix(docs, none, TARGETS).collect()
    assert [r.rate for r in rows] == [1.0] * 5 and sorted(r.tokens for r in rows) == [
        0, 0, 2, 2, 60_000]
    some = spark.createDataFrame([(3, "high"), (4, "low"), (4, "high"), (None, "low"), (5, None)],
                                 "doc_id bigint, domain string")
    assert all(r.rate >= 0 for r in soft_mix(docs, some, TARGETS).collect())
    assert mixed(docs, some, TARGETS).columns == docs.columns
    empty = docs.where("doc_id > 99")
    assert soft_mix(empty, some, TARGETS).collect() == [] and mixed(empty, some, TARGETS).collect() == []
    ids = spark.createDataFrame([(None, "a", None, None), (1, "a", "x", "y"), (1, "a", "x", "y")],
                                "doc_id bigint, text string, lang string, source string")
    assert len(soft_mix(ids, some, TARGETS).collect()) == 3
    assert mixed(ids, none, TARGETS).count() == 3


def test_no_python_in_the_plan(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    plan = mixed(docs, labels(spark, folder), TARGETS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan
