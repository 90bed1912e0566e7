"""Graders: regression, neighbours and bell curve, and the complete runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.catalog.similarity import document_tokens, tagged_tokens
from gradeloom.functions.constants import EXPERIMENT_SEED, SPLIT_SEED
from gradeloom.operators import grading as gr, lexicon as lx, similarity as sm
from gradeloom.operators.models import assemble, fit_and_predict, weighted_train
from gradeloom.operators.neighbour_index import hashed_nearest, recall, tree_nearest
from gradeloom.operators.neighbours import nearest, vote
from gradeloom.operators.split import stratified_split
from gradeloom.plans import runs
from gradeloom.sources.essays import essay_view, ratings
from gradeloom.sources.staging import stage
from gradeloom.sources.tables import table

BELL = sql.with_(sql.tokens(), sql.grams(), sql.top(), sql.matched()) + """
, sims AS (SELECT doc_key, group_key, hits::DOUBLE / list_size AS similarity FROM matched)
, stats AS (SELECT group_key, avg(similarity) AS mean, stddev_pop(similarity) AS dev
            FROM sims GROUP BY group_key)
, z AS (SELECT doc_key, group_key, (similarity - mean) / mean AS z, (similarity - mean) / dev AS zd
        FROM sims JOIN stats USING (group_key))"""


def sql_grade(z: str) -> str:
    return (f"CASE WHEN {z} >= 2 THEN 6 WHEN {z} >= 1.5 THEN 5 WHEN {z} >= 0.5 THEN 4 "
            f"WHEN {z} >= -0.5 THEN 3 WHEN {z} >= -1.5 THEN 2 ELSE 1 END::BIGINT")


def document_scores(spark, folder):
    return stage(sm.score_documents(document_tokens(spark, folder)).select(
        "doc_key", "group_key", "similarity"), "scores")


@query("similarity_z_scores", "W6 A7", BELL + "SELECT doc_key, round(z, 6) AS z FROM z")
def similarity_z_scores(spark, folder):
    scored = gr.z_scores(document_scores(spark, folder), ["group_key"], "similarity")
    return scored.select("doc_key", F.round("z", 6).alias("z"))


@query("bell_curve_grades", "M6", BELL + f"""
SELECT doc_key, group_key, {sql_grade('z')} AS grade, {sql_grade('zd')} AS grade_by_deviation
FROM z""")
def bell_curve_grades(spark, folder):
    scores = document_scores(spark, folder)
    plain = gr.bell_curve_grades(scores, ["group_key"], "similarity")
    both = gr.z_scores(plain.drop("z"), ["group_key"], "similarity", spread="std")
    return both.select("doc_key", "group_key", "grade",
                       gr.bell_grade(F.col("z")).alias("grade_by_deviation"))


def embedding_points(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.lit("all").alias("part"), F.col("vec_id").alias("id"),
        F.col("embedding").alias("features"), "label")
    return vectors.where(F.col("id") % 5 == 0), vectors.where(F.col("id") % 5 != 0)


NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
pairs AS (
  SELECT q.vec_id AS query, t.vec_id AS neighbour, t.label,
    list_sum(list_transform(list_zip(q.e, t.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2
  FROM v q JOIN v t ON q.vec_id % 5 = 0 AND t.vec_id % 5 <> 0),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank
                 FROM pairs) WHERE rank <= 6),
votes AS (SELECT query, label, count(*) AS votes FROM best GROUP BY query, label),
voted AS (SELECT query, label AS predicted, votes FROM (SELECT *, row_number() OVER (
    PARTITION BY query ORDER BY votes DESC, label) AS r FROM votes) WHERE r = 1)
"""


@query("nearest_neighbours", "J5 K4", NEAREST + """
SELECT query, neighbour, rank, round(d2, 6) AS d2 FROM best""")
def nearest_neighbours(spark, folder):
    found = nearest(*embedding_points(spark, folder))
    return found.select("query", "neighbour", "rank", F.round("d2", 6).alias("d2"))


@query("neighbour_votes", "M4", NEAREST + """
SELECT query, predicted::BIGINT AS predicted, votes FROM voted""")
def neighbour_votes(spark, folder):
    queries, train = embedding_points(spark, folder)
    return vote(nearest(queries, train), train.select("id", "label"))


ESSAY_POINTS = sql.with_(sql.FILLED, sql.split("filled")) + """
, points AS (
  SELECT essay_id, prompt_name, score, is_test, essay_word_count::DOUBLE AS a,
    grade_level::DOUBLE AS b FROM split)
, pairs AS (
  SELECT q.essay_id AS query, t.essay_id AS neighbour, t.score,
    (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b) AS d2
  FROM points q JOIN points t ON q.prompt_name = t.prompt_name AND q.is_test AND NOT t.is_test)
, best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank
                 FROM pairs) WHERE rank <= 6)
, voted AS (
  SELECT query, score FROM (
    SELECT query, score, row_number() OVER (PARTITION BY query ORDER BY count(*) DESC, score) AS r
    FROM best GROUP BY query, score) WHERE r = 1)"""


@query("neighbour_grades", "M4 M5", ESSAY_POINTS + """
SELECT v.query AS essay_id, v.score AS predicted, p.score
FROM voted v JOIN points p ON p.essay_id = v.query""")
def neighbour_grades(spark, folder):
    filled = runs.filled_essays(essay_view(spark, folder))
    split = stage(stratified_split(filled.select(
        "essay_id", "prompt_name", "score", "essay_word_count", "grade_level")), "split")
    points = split.select(
        F.col("prompt_name").alias("part"), F.col("essay_id").alias("id"),
        F.array(F.col("essay_word_count").cast("double"), F.col("grade_level").cast("double"))
        .alias("features"), F.col("score").alias("label"), "is_test")
    train = points.where(~F.col("is_test"))
    voted = vote(nearest(points.where("is_test"), train), train)
    return voted.select(F.col("query").alias("essay_id"), "predicted").join(
        split.select("essay_id", "score"), "essay_id")


@query("neighbour_recall", "M5 J5", NEAREST + """
SELECT count(*) AS neighbours, TRUE AS nine_in_ten FROM best""")
def neighbour_recall(spark, folder):
    """The hashed index beside the exact search: at least nine in ten neighbours are found."""
    queries, train = embedding_points(spark, folder)
    exact, found = stage(nearest(queries, train), "exact"), hashed_nearest(queries, train)
    return recall(exact, found).select("neighbours", (F.col("recall") >= 0.9).alias("nine_in_ten"))


LINE_COLUMNS = {"l_quantity": 50, "l_extendedprice": 100000, "l_discount": 0.1, "l_tax": 0.1}


def order_points(spark, folder):
    """Orders as points of their largest line items, by return flag; every 25th order is a query."""
    orders = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_returnflag").alias("part"), F.array(*(
            F.max(c) / F.lit(float(unit)) for c, unit in LINE_COLUMNS.items())).alias("features"))
    orders = stage(orders, "orders")
    return orders.where("id % 25 = 0"), orders.where("id % 25 != 0")


@query("tree_neighbours", "J5 K4 M5", f"""
WITH p AS (
  SELECT l_orderkey AS id, min(l_returnflag) AS part,
    {", ".join(f"max({c}) / {float(unit)}::DOUBLE AS {c}" for c, unit in LINE_COLUMNS.items())}
  FROM lineitem GROUP BY l_orderkey),
pairs AS (
  SELECT q.id AS query, t.id AS neighbour,
    {" + ".join(f"(q.{c} - t.{c}) * (q.{c} - t.{c})" for c in LINE_COLUMNS)} AS d2
  FROM p q JOIN p t ON q.part = t.part AND q.id % 25 = 0 AND t.id % 25 <> 0)
SELECT query, neighbour, rank, round(d2, 9) AS d2 FROM (
  SELECT *, row_number() OVER (PARTITION BY query ORDER BY d2, neighbour) AS rank FROM pairs)
WHERE rank <= 6""")
def tree_neighbours(spark, folder):
    found = tree_nearest(*order_points(spark, folder))
    return found.select("query", "neighbour", "rank", F.round("d2", 9).alias("d2"))


def embedding_rows(spark, folder):
    vectors = table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("essay_id"), F.lit("all").alias("prompt_name"),
        F.col("label").cast("bigint").alias("score"), "embedding")
    split = stage(stratified_split(vectors), "split")
    rows = split.select("essay_id", "prompt_name", "score", "is_test",
                        *(F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)))
    return assemble(rows, [f"e{i}" for i in range(64)]).select(
        "essay_id", "prompt_name", "score", "is_test", "vector")


KEEP = ["essay_id", "prompt_name", "score"]


def _graded(rows, penalty_c, **options):
    train = stage(weighted_train(
        rows.where(~F.col("is_test")), "prompt_name", "score", "exponential"), "train")
    return fit_and_predict(
        train, rows.where("is_test"), KEEP, penalty_c=penalty_c, **options)


@query("logistic_grades", "M1 M3")
def logistic_grades(spark, folder):
    rows = embedding_rows(spark, folder)
    return _graded(rows, None)


@query("penalised_logistic_grades", "M2 M3")
def penalised_logistic_grades(spark, folder):
    rows = embedding_rows(spark, folder)
    return _graded(rows, 1.0)


@query("class_probabilities", "M10")
def class_probabilities(spark, folder):
    rows = embedding_rows(spark, folder)
    scored = _graded(rows, 1.0, probabilities=True)
    return scored.select("essay_id", F.posexplode("probability").alias("label", "probability"))


@query("baseline_run", "M7 M3")
def baseline_run(spark, folder):
    return runs.baseline_run(essay_view(spark, folder))


@query("experiment_run", "M8 J6")
def experiment_run(spark, folder):
    lexicon = stage(lx.build_lexicon(tagged_tokens(document_tokens(spark, folder))), "lexicon")
    return runs.experiment_run(essay_view(spark, folder), lexicon)


@query("main_run", "M9 E6")
def main_run(spark, folder):
    settings = runs.Settings(models=("bell", "logistic", "neighbours"))
    return runs.main_run(essay_view(spark, folder), settings)


@query("bell_curve_distribution", "M6 E5", BELL + f"""
, {sql.SCORED.strip()}
, graded AS (SELECT z.group_key AS prompt_name, s.score, {sql_grade('z.z')} AS grade
             FROM z JOIN scored s ON s.doc_id = z.doc_key)
, p AS (SELECT prompt_name, grade, count(*) AS predicted FROM graded GROUP BY 1, 2)
, t AS (SELECT prompt_name, score AS grade, count(*) AS actual FROM graded GROUP BY 1, 2)
SELECT prompt_name, grade, predicted, actual FROM p FULL JOIN t USING (prompt_name, grade)""")
def bell_curve_distribution(spark, folder):
    from gradeloom.operators.metrics import grade_distribution
    graded = gr.bell_curve_grades(document_scores(spark, folder), ["group_key"], "similarity")
    truth = ratings(spark, folder).select(F.col("essay_id").alias("doc_key"), "score")
    return grade_distribution(
        graded.join(truth, "doc_key").withColumnRenamed("group_key", "prompt_name"),
        ["prompt_name"], predicted="grade")


# What the runs report without their regression: fills, codes, strata, bell curve and tables.
CODED = """
coded AS (
  SELECT essay_id, CAST(dense_rank() OVER (ORDER BY prompt_name) - 1 AS VARCHAR) AS prompt, prompt_name
  FROM filled)"""


def actuals_sql(model: str, seed: int) -> str:
    """Test rows by score, as the run of ``model`` reports them."""
    return sql.with_(sql.FILLED, CODED, sql.split("filled", seed)) + f"""
SELECT c.prompt, '{model}' AS model, concat('actual_', s.score) AS metric, count(*)::DOUBLE AS value
FROM split s JOIN coded c USING (essay_id) WHERE s.is_test GROUP BY ALL"""


@query("baseline_run_actuals", "M7 E6", actuals_sql("base_logistic", SPLIT_SEED))
def baseline_run_actuals(spark, folder):
    return runs.baseline_run(essay_view(spark, folder)).where("metric LIKE 'actual%'")


@query("experiment_run_actuals", "M8 E6", actuals_sql("experiment_logistic", EXPERIMENT_SEED))
def experiment_run_actuals(spark, folder):
    return experiment_run(spark, folder).where("metric LIKE 'actual%'")


@query("main_run_bell", "M9 M6 E6", sql.with_(
    sql.FILLED, CODED, sql.tokens("filled", "essay_id", "full_text", "prompt_name", "row_id"),
    sql.grams(), sql.top(), sql.matched()) + f"""
, sims AS (SELECT doc_key AS essay_id, CASE WHEN list_size = 0 THEN 0 ELSE hits::DOUBLE / list_size END AS s
           FROM matched)
, stats AS (SELECT prompt_name, avg(s) AS mean FROM sims JOIN coded USING (essay_id) GROUP BY ALL)
, graded AS (
  SELECT c.prompt, f.score, {sql_grade('(s - mean) / mean')} AS grade
  FROM sims JOIN coded c USING (essay_id) JOIN stats USING (prompt_name) JOIN filled f USING (essay_id))
SELECT prompt, 'main_bell' AS model, metric, round(value, 6) AS value FROM (
  SELECT prompt, concat('predicted_', grade) AS metric, count(*)::DOUBLE AS value FROM graded GROUP BY ALL
  UNION ALL
  SELECT prompt, concat('actual_', score), count(*)::DOUBLE FROM graded GROUP BY ALL
  UNION ALL
  SELECT prompt, 'accuracy', avg(CASE WHEN score = grade THEN 1.0 ELSE 0.0 END) FROM graded GROUP BY ALL)""")
def main_run_bell(spark, folder):
    found = runs.main_run(essay_view(spark, folder), runs.Settings(models=("bell",)))
    return found.where("model = 'main_bell' AND metric NOT IN ('precision', 'recall', 'f1_score')").select(
        "prompt", "model", "metric", F.round("value", 6).alias("value"))
