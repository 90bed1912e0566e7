import numpy as np
import pytest
from pyspark.sql import functions as F

from gradeloom.operators import metrics as mt, profile as pf
from gradeloom.operators.grading import bell_curve_grades


def pairs(spark, truth, predicted):
    return spark.createDataFrame(
        [("p", t, q) for t, q in zip(truth, predicted)], "g string, score int, predicted int")


def plain_kappa(truth, predicted):
    o = np.zeros((6, 6))
    for t, p in zip(truth, predicted):
        o[t - 1, p - 1] += 1
    w = np.subtract.outer(np.arange(6), np.arange(6)) ** 2
    e = np.outer(o.sum(1), o.sum(0)) / o.sum()
    return 1 - (w * o).sum() / (w * e).sum()


def test_kappa_of_ten_pairs(spark):
    truth, predicted = [1, 2, 3, 4, 5, 6, 1, 2, 3, 4], [1, 2, 3, 3, 5, 6, 2, 2, 2, 4]
    got = mt.quadratic_weighted_kappa(pairs(spark, truth, predicted), ["g"]).first().kappa
    assert got == pytest.approx(0.9361702127659575, abs=1e-15)


def test_kappa_against_matrices(spark):
    rng = np.random.default_rng(3)
    truth, predicted = rng.integers(1, 7, 300).tolist(), rng.integers(1, 7, 300).tolist()
    got = mt.quadratic_weighted_kappa(pairs(spark, truth, predicted), []).first().kappa
    assert got == pytest.approx(plain_kappa(truth, predicted), abs=1e-12)


def test_kappa_edges(spark):
    def kappa(t, p):
        return mt.quadratic_weighted_kappa(pairs(spark, t, p), ["g"]).first().kappa
    assert kappa([3, 3], [3, 3]) == 1.0
    assert kappa([1, 4, 6], [1, 4, 6]) == 1.0
    for bad in (0, 7):
        with pytest.raises(Exception, match="between 1 and 6"):
            kappa([bad, 3], [3, 3])


def test_kappa_does_not_overflow(spark):
    # 10^10 rows: observed 25 * 2e9, expected 2 * 25 * 5e9 * 5e9 / 1e10.
    cells = [("p", 1, 1, 4 * 10**9), ("p", 6, 6, 4 * 10**9), ("p", 1, 6, 10**9), ("p", 6, 1, 10**9)]
    table = spark.createDataFrame(cells, "g string, score int, predicted int, rows bigint")
    got = mt.quadratic_weighted_kappa(table, ["g"], counted=True).first().kappa
    assert got == pytest.approx(0.6, abs=1e-12)


@pytest.mark.parametrize("by", [["g"], []])
@pytest.mark.parametrize("truth, predicted, value", [
    ([1, 2, 2, 5], [1, 1, 3, 4], 7.5),  # observed 3, expected 64 / 4, own 72 / 4
    ([1, 2, 2, 5, 6], [1, 1, 3, 4, 6], 7.5),  # the highest grade is out of range
    ([6, 6], [6, 1], 0.0), ([2, 2], [2, 2], 1.0), ([1, 2, 3], [3, 1, 2], 0.0)])
def test_shifted_kappa(spark, by, truth, predicted, value):
    got = mt.shifted_kappa(pairs(spark, truth, predicted), by).first().kappa
    assert got == pytest.approx(value, abs=1e-9)


def test_shifted_kappa_needs_ratings(spark):
    with pytest.raises(Exception, match="no ratings"):
        mt.shifted_kappa(pairs(spark, [1], [1]).where("score > 1"), []).collect()


def test_metrics_accept_the_confusion_table(spark):
    df = pairs(spark, [1, 2, 3, 3, 5], [1, 2, 2, 3, 6])
    table = mt.confusion(df, ["g"])
    for metric in (mt.quadratic_weighted_kappa, mt.shifted_kappa, mt.accuracy, mt.evaluate,
                   mt.class_report, mt.grade_distribution):
        assert sorted(map(str, metric(df, ["g"]).collect())) == sorted(
            map(str, metric(table, ["g"], counted=True).collect()))


def test_a_column_named_rows_is_no_confusion_table(spark):
    df = pairs(spark, [1, 2], [1, 3]).withColumn("rows", F.lit(5))
    assert mt.accuracy(df, ["g"]).first().accuracy == 0.5
    assert sum(r.rows for r in mt.confusion(df, ["g"]).collect()) == 2


def test_weighted_accuracy_needs_every_weight(spark):
    df = pairs(spark, [1, 1, 2], [1, 2, 2])
    weights = spark.createDataFrame([("p", 1, 0.5), ("p", 2, 2.0)], "g string, score int, weight double")
    got = mt.weighted_accuracy(df, ["g"], weights).first().weighted_accuracy
    assert got == pytest.approx(2.5 / 3.0)
    assert mt.weighted_accuracy(df, ["g"]).first().weighted_accuracy == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="no weight"):
        mt.weighted_accuracy(df, ["g"], weights.where("score = 1")).collect()


def test_evaluation_agrees_with_the_ml_evaluator(spark):
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    rng = np.random.default_rng(9)
    df = pairs(spark, rng.integers(1, 6, 150).tolist(), rng.integers(2, 7, 150).tolist())
    ours = mt.evaluate(df, ["g"]).first()
    doubles = df.select(F.col("score").cast("double"), F.col("predicted").cast("double"))
    for name, metric in (("accuracy", "accuracy"), ("precision", "weightedPrecision"),
                         ("recall", "weightedRecall"), ("f1_score", "f1")):
        theirs = MulticlassClassificationEvaluator(
            labelCol="score", predictionCol="predicted", metricName=metric).evaluate(doubles)
        assert ours[name] == pytest.approx(theirs)


def test_dense_confusion_adds_up(spark):
    got = mt.dense_confusion(pairs(spark, [1, 1, 2], [1, 2, 2]), ["g"], "score", "predicted")
    cells = got.collect()
    assert len(cells) == 36 and sum(r.rows for r in cells) == 3
    assert sum(r.expected for r in cells) == pytest.approx(3)


def test_distribution_leaves_holes_null(spark):
    got = {r.grade: (r.predicted, r.actual) for r in mt.grade_distribution(
        pairs(spark, [1, 1, 2], [2, 2, 3]), ["g"]).collect()}
    assert got == {1: (None, 2), 2: (2, 1), 3: (1, None)}


@pytest.mark.parametrize("scores,grades", [
    ([0.0, 1.0, 2.0, 3.0], [2, 3, 3, 4]), ([0.0, 0.0], [None, None])])
def test_bell_curve(spark, scores, grades):
    df = spark.createDataFrame([("p", i, s) for i, s in enumerate(scores)], "g string, i int, s double")
    got = bell_curve_grades(df, ["g"], "s").orderBy("i").collect()
    assert [r.grade for r in got] == grades


def test_describe_against_numpy(spark, many_tasks):
    rng = np.random.default_rng(1)
    values = [None if i % 11 == 0 else float(v) for i, v in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = pf.describe(df).first()
    known = np.array([v for v in values if v is not None])
    assert got["count"] == len(known)
    assert got["std"] == pytest.approx(known.std(ddof=1))
    assert [got.q25, got.q50, got.q75] == pytest.approx(np.percentile(known, [25, 50, 75]).tolist())


def test_describe_single_value(spark):
    got = pf.describe(spark.createDataFrame([(2.0,)], "x double")).first()
    assert (got.q25, got.q50, got.q75, got.std) == (2.0, 2.0, 2.0, None)


def test_histogram_last_bin_is_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0, 29, 30, 1499, 1500, 1501)], "x int")
    got = {r.bin: r.rows for r in pf.histogram(df, "x", 50, 0.0, 1500.0).collect()}
    assert (got[0], got[1], got[49], sum(got.values()), len(got)) == (2, 1, 2, 5, 50)


def test_correlations_drop_nulls_per_pair(spark):
    df = spark.createDataFrame(
        [(1, 2, 1), (2, 4, None), (3, 6, 0), (4, 8, 5)], "a int, b int, c int")
    got = {(r.a, r.b): r.correlation for r in pf.correlations(df).collect()}
    assert got[("a", "b")] == pytest.approx(1) and got[("c", "a")] == pytest.approx(
        np.corrcoef([1, 3, 4], [1, 0, 5])[0, 1])
    assert len(got) == 9


def test_histogram_of_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    for given in (df, df.where("x > 0")):
        got = [tuple(r) for r in pf.histogram(given, "x", 2).orderBy("bin").collect()]
        assert got == [(0, 0.0, 0), (1, 0.5, 0)]
