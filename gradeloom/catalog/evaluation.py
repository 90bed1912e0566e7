"""Agreement and classification metrics over rating pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.operators import metrics as mt
from gradeloom.operators.split import class_weights
from gradeloom.sources.essays import ratings
from gradeloom.sources.results import append_results
from gradeloom.sources.staging import fresh_path, stage
from gradeloom.sources.tables import table
from gradeloom.plans.runs import scores_of

BY = ["prompt_name"]
PAIRS = sql.with_(sql.SCORED, sql.RATINGS)

SUMS = """
, sums AS (
  SELECT prompt_name, count(*)::HUGEINT AS n, sum(score)::HUGEINT AS st, sum(predicted)::HUGEINT AS sp,
    sum(score * score)::HUGEINT AS stt, sum(predicted * predicted)::HUGEINT AS spp,
    sum((score - predicted) * (score - predicted))::HUGEINT AS diff
  FROM ratings {where} GROUP BY prompt_name)"""
KAPPA = PAIRS + SUMS.format(where="") + """
, kappas AS (
  SELECT prompt_name, CASE WHEN n * stt - 2 * st * sp + n * spp = 0
    THEN CASE WHEN diff = 0 THEN 1.0 ELSE 0.0 END
    ELSE 1.0 - (n * diff)::DOUBLE / (n * stt - 2 * st * sp + n * spp)::DOUBLE END::DOUBLE AS kappa
  FROM sums)"""

REPORT = """
, labels AS (
  SELECT prompt_name, label, sum(t) AS support, sum(p) AS called, sum(h) AS hit FROM (
    SELECT prompt_name, score AS label, 1 AS t, 0 AS p, (score = predicted)::INT AS h FROM ratings
    UNION ALL SELECT prompt_name, predicted, 0, 1, 0 FROM ratings)
  GROUP BY prompt_name, label)
, report AS (
  SELECT prompt_name, label, support::BIGINT AS support,
    coalesce(hit::DOUBLE / nullif(called, 0), 0) AS precision,
    coalesce(hit::DOUBLE / nullif(support, 0), 0) AS recall,
    coalesce(2.0::DOUBLE * hit / nullif(called + support, 0), 0) AS f1_score
  FROM labels)
, overall AS (
  SELECT prompt_name, sum(recall * support) / sum(support) AS accuracy,
    sum(precision * support) / sum(support) AS precision,
    sum(recall * support) / sum(support) AS recall,
    sum(f1_score * support) / sum(support) AS f1_score
  FROM report GROUP BY prompt_name)"""

WEIGHTED = """
, weights AS (
  SELECT prompt_name, score, exp(-count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY prompt_name))
    AS weight FROM ratings GROUP BY prompt_name, score)
, weighted AS (
  SELECT r.prompt_name, sum(CASE WHEN r.score = r.predicted THEN w.weight ELSE 0 END) / sum(w.weight)
    AS weighted_accuracy
  FROM ratings r JOIN weights w ON w.prompt_name = r.prompt_name AND w.score = r.score
  GROUP BY r.prompt_name)"""


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("weighted_kappa", "E1 P8", KAPPA + "SELECT prompt_name, kappa FROM kappas")
def weighted_kappa(spark, folder):
    return mt.quadratic_weighted_kappa(ratings(spark, folder), BY)


@query("overall_kappa", "E1", PAIRS + """
, n AS (SELECT count(*) AS total FROM ratings)
, o AS (SELECT sum((score - predicted) ** 2) AS seen FROM ratings)
, t AS (SELECT score AS i, count(*) AS r FROM ratings GROUP BY 1)
, p AS (SELECT predicted AS j, count(*) AS c FROM ratings GROUP BY 1)
, e AS (SELECT sum((i - j) ** 2 * r * c) AS wanted FROM t, p)
SELECT round(1 - seen * total / wanted, 9)::DOUBLE AS kappa FROM n, o, e""")
def overall_kappa(spark, folder):
    return rounded(mt.quadratic_weighted_kappa(ratings(spark, folder), []), ["kappa"], 9)


@query("shifted_kappa", "E2 P9", PAIRS + SUMS.format(
    where="WHERE score BETWEEN 1 AND 5 AND predicted BETWEEN 1 AND 5") + """
, parts AS (
  SELECT prompt_name, diff::DOUBLE AS o, (n * stt - 2 * st * sp + n * spp)::DOUBLE / n AS e,
    (2 * (n * stt - st * st))::DOUBLE / n AS own FROM sums)
SELECT prompt_name, round(CASE WHEN abs(own - e) < 1e-10 THEN CASE WHEN o = e THEN 1 ELSE 0 END
  ELSE 1 - (o - e) / (own - e) END::DOUBLE, 9) AS kappa FROM parts""")
def shifted_kappa(spark, folder):
    return rounded(mt.shifted_kappa(ratings(spark, folder), BY), ["kappa"], 9)


@query("weighted_accuracy", "E3 J3", PAIRS + WEIGHTED + """
SELECT prompt_name, round(weighted_accuracy, 6) AS weighted_accuracy FROM weighted""")
def weighted_accuracy(spark, folder):
    pairs = stage(ratings(spark, folder), "pairs")
    weights = stage(class_weights(pairs), "weights")
    return rounded(mt.weighted_accuracy(pairs, BY, weights), ["weighted_accuracy"])


@query("weight_lookup", "J3", PAIRS + WEIGHTED + """
SELECT r.essay_id, r.score, round(w.weight, 9) AS weight FROM ratings r
JOIN weights w ON w.prompt_name = r.prompt_name AND w.score = r.score""")
def weight_lookup(spark, folder):
    from gradeloom.operators.models import weighted_train
    pairs = stage(ratings(spark, folder), "pairs")
    return weighted_train(pairs, "prompt_name", "score", "exponential").select(
        "essay_id", "score", F.round("weight", 9).alias("weight"))


@query("evaluation", "E4", PAIRS + REPORT + """
SELECT prompt_name, round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
  round(recall, 6) AS recall, round(f1_score, 6) AS f1_score FROM overall""")
def evaluation(spark, folder):
    return rounded(mt.evaluate(ratings(spark, folder), BY),
                   ["accuracy", "precision", "recall", "f1_score"])


@query("toxicity_evaluation", "E4 E7", """
WITH c AS (SELECT count(*) AS n, count(*) FILTER (WHERE quality = toxic) AS hit FROM labels)
SELECT hit::DOUBLE / n AS accuracy FROM c""")
def toxicity_evaluation(spark, folder):
    return mt.accuracy(table(spark, folder, "labels"), [], "quality", "toxic")


@query("plain_accuracy", "E7", PAIRS + """
SELECT prompt_name, count(*) FILTER (WHERE score = predicted)::DOUBLE / count(*) AS accuracy
FROM ratings GROUP BY prompt_name""")
def plain_accuracy(spark, folder):
    return mt.accuracy(ratings(spark, folder), BY)


@query("class_report", "E8", PAIRS + REPORT + """
SELECT prompt_name, label, support, precision, recall, f1_score FROM report""")
def class_report(spark, folder):
    return mt.class_report(ratings(spark, folder), BY)


@query("confusion_table", "A12 P8", PAIRS + """
SELECT prompt_name, score, predicted, count(*) AS rows FROM ratings GROUP BY ALL""")
def confusion_table(spark, folder):
    pairs = mt.checked(ratings(spark, folder), ["score", "predicted"])
    return mt.confusion(pairs, BY, "score", "predicted")


@query("expected_confusion", "A13 A12", PAIRS + """
, g AS (SELECT p.prompt_name, i.i AS score, j.j AS predicted
        FROM (SELECT DISTINCT prompt_name FROM ratings) p,
             (SELECT unnest(range(1, 7)) AS i) i, (SELECT unnest(range(1, 7)) AS j) j)
, r AS (SELECT prompt_name, score, count(*) AS n FROM ratings GROUP BY ALL)
, c AS (SELECT prompt_name, predicted, count(*) AS n FROM ratings GROUP BY ALL)
, a AS (SELECT prompt_name, count(*) AS n FROM ratings GROUP BY ALL)
, o AS (SELECT prompt_name, score, predicted, count(*) AS n FROM ratings GROUP BY ALL)
SELECT prompt_name, score, predicted, coalesce(o.n, 0) AS rows, coalesce(r.n, 0) AS truth_rows,
  coalesce(c.n, 0) AS predicted_rows,
  (coalesce(r.n, 0) * coalesce(c.n, 0))::DOUBLE / a.n AS expected
FROM g LEFT JOIN o USING (prompt_name, score, predicted) LEFT JOIN r USING (prompt_name, score)
LEFT JOIN c USING (prompt_name, predicted) JOIN a USING (prompt_name)""")
def expected_confusion(spark, folder):
    return mt.dense_confusion(ratings(spark, folder), BY, "score", "predicted")


DISTRIBUTION = """
, p AS (SELECT prompt_name, predicted AS grade, count(*) AS predicted FROM {0} GROUP BY 1, 2)
, t AS (SELECT prompt_name, score AS grade, count(*) AS actual FROM {0} GROUP BY 1, 2)
, grades AS (SELECT prompt_name, grade, predicted, actual
             FROM p FULL JOIN t USING (prompt_name, grade))"""


@query("grade_distribution", "E5 J2", PAIRS + """
, skewed AS (SELECT prompt_name, score, CASE WHEN predicted = 1 THEN 2 ELSE predicted END
             AS predicted FROM ratings)""" + DISTRIBUTION.format("skewed") + """
SELECT prompt_name, grade, predicted, actual FROM grades""")
def grade_distribution(spark, folder):
    # No prediction of 1, so that one side of the table has a hole.
    skewed = ratings(spark, folder).withColumn(
        "predicted", F.greatest(F.col("predicted"), F.lit(2)))
    return mt.grade_distribution(skewed, BY)


RESULTS = KAPPA + WEIGHTED + REPORT + DISTRIBUTION.format("ratings") + """
, results AS (
  SELECT prompt_name AS prompt, 'kappa' AS metric, kappa AS value FROM kappas
  UNION ALL SELECT prompt_name, 'weighted_accuracy', weighted_accuracy FROM weighted
  UNION ALL SELECT prompt_name, 'accuracy', accuracy FROM overall
  UNION ALL SELECT prompt_name, 'precision', precision FROM overall
  UNION ALL SELECT prompt_name, 'recall', recall FROM overall
  UNION ALL SELECT prompt_name, 'f1_score', f1_score FROM overall
  UNION ALL SELECT prompt_name, 'predicted_' || grade, predicted FROM grades
    WHERE predicted IS NOT NULL
  UNION ALL SELECT prompt_name, 'actual_' || grade, actual FROM grades WHERE actual IS NOT NULL)"""


@query("results_report", "E6", RESULTS + """
SELECT prompt, 'ratings' AS model, metric, round(value::DOUBLE, 6) AS value FROM results""")
def results_report(spark, folder):
    pairs = stage(ratings(spark, folder), "pairs")
    weights = stage(class_weights(pairs), "weights")
    return rounded(scores_of(pairs, weights, "ratings"), ["value"])


@query("appended_results", "S3", RESULTS + """
SELECT prompt, model, metric, round(value::DOUBLE, 4) AS value
FROM results, (SELECT unnest(['first', 'second']) AS model)""")
def appended_results(spark, folder):
    pairs = stage(ratings(spark, folder), "pairs")
    weights = stage(class_weights(pairs), "weights")
    path = fresh_path(spark, "results")
    for run in ("first", "second"):
        append_results(scores_of(pairs, weights, run), path)
    return spark.read.parquet(path).select("prompt", "model", "metric", "value")
