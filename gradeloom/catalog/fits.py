"""Regression fitted to its optimum, and models that are saved and loaded again.

The SQL side is a solver of its own: accelerated gradient steps over the same training rows as a
recursive query. The loss is convex, so both sides must meet in the same probabilities.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.operators import saved_models
from gradeloom.operators.models import assemble, fit_and_predict, fit_coefficients, weighted_train
from gradeloom.operators.split import stratified_split
from gradeloom.sources.essays import ratings
from gradeloom.sources.staging import fresh_path, stage
from gradeloom.sources.tables import table

COLUMNS = ["length", "weekday"]
CLASSES = 3
SIZE = len(COLUMNS) + 1
PENALTY_C = 0.1
# To the optimum, far closer than the three decimals that are compared.
TIGHT = {"tol": 1e-13, "max_iter": 3000}

POINTS = """
points AS (
  SELECT r.essay_id, r.prompt_name, ln(d.n_chars + 1) - 7 AS length, (d.doc_id % 7 - 3) / 3.0 AS weekday,
    (r.predicted + 1) // 2 AS score
  FROM ratings r JOIN documents d ON d.doc_id = r.essay_id)"""


def rating_points(spark, folder):
    """Ratings in three levels with two columns to tell them by, split by strata."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("essay_id"), "n_chars")
    rows = ratings(spark, folder).join(docs, "essay_id").select(
        "essay_id", "prompt_name", (F.log(F.col("n_chars") + 1) - 7).alias("length"),
        ((F.col("essay_id") % 7 - 3) / F.lit(3.0)).alias("weekday"),
        F.expr("(predicted + 1) div 2").alias("score"))
    return stage(stratified_split(rows), "points")


def _terms(w: str, c: int) -> str:
    inputs = ["length", "weekday", "1"]
    return "(" + " + ".join(f"{w}[{SIZE * c + j + 1}] * {x}" for j, x in enumerate(inputs)) + ")"


def _shares(w: str) -> str:
    raised = [f"exp({_terms(w, c)})" for c in range(CLASSES)]
    return ", ".join(f"{r} / ({' + '.join(raised)}) AS p{c + 1}" for c, r in enumerate(raised))


def solver(strength: float, steps: int) -> str:
    """``fitted``: per prompt the weights (class by class, the intercept last) after ``steps``."""
    penalties = [strength if j < SIZE - 1 else 0.0 for _ in range(CLASSES) for j in range(SIZE)]
    slopes = ", ".join(
        f"sum(weight * (p{c + 1} - CASE WHEN score = {c + 1} THEN 1 ELSE 0 END) * {x})"
        f" + {penalties[SIZE * c + j]} * any_value(z)[{SIZE * c + j + 1}]"
        for c in range(CLASSES) for j, x in enumerate(["length", "weekday", "1"]))
    size = CLASSES * SIZE
    return ",\n".join(p.strip() for p in (sql.SCORED, sql.RATINGS, POINTS, sql.split("points"), sql.WEIGHTS)) + f""",
train AS (
  SELECT s.prompt_name, s.score, s.length, s.weekday, w.weight
  FROM split s JOIN weights w ON w.prompt_name = s.prompt_name AND w.score = s.score
  WHERE NOT s.is_test),
steep AS (
  SELECT prompt_name, 0.5 * sum(weight * (length * length + weekday * weekday + 1)) + {strength} AS most
  FROM train GROUP BY prompt_name),
fit AS (
  SELECT prompt_name, 0 AS step, list_transform(range({size}), lambda i: 0.0::DOUBLE) AS w,
    list_transform(range({size}), lambda i: 0.0::DOUBLE) AS z
  FROM steep
  UNION ALL
  SELECT prompt_name, step + 1, next,
    list_transform(list_zip(next, w), lambda v: v[1] + step / (step + 3.0) * (v[1] - v[2]))
  FROM (
    SELECT prompt_name, step, w, list_transform(list_zip(z, slope), lambda v: v[1] - v[2] / most) AS next
    FROM (
      SELECT prompt_name, step, any_value(w) AS w, any_value(z) AS z, any_value(most) AS most,
        [{slopes}] AS slope
      FROM (SELECT f.*, t.* EXCLUDE (prompt_name), s.most, {_shares('f.z')}
            FROM fit f JOIN train t ON t.prompt_name = f.prompt_name
            JOIN steep s ON s.prompt_name = f.prompt_name WHERE f.step < {steps})
      GROUP BY prompt_name, step))),
graded AS (
  SELECT s.essay_id, s.prompt_name, {_shares('f.w')}
  FROM split s JOIN fit f ON f.prompt_name = s.prompt_name AND f.step = {steps}
  WHERE s.is_test)"""


def probabilities_sql(strength: float, steps: int) -> str:
    each = " UNION ALL ".join(
        f"SELECT essay_id, {c + 1}::BIGINT AS label, round(p{c + 1}, 3) AS probability FROM graded"
        for c in range(CLASSES))
    return f"WITH RECURSIVE {solver(strength, steps)}\n{each}"


def _train(rows):
    return stage(weighted_train(
        rows.where(~F.col("is_test")), "prompt_name", "score", "exponential"), "train")


def _probabilities(spark, folder, penalty_c):
    rows = assemble(rating_points(spark, folder), COLUMNS).select(
        "essay_id", "prompt_name", "score", "is_test", "vector")
    scored = fit_and_predict(_train(rows), rows.where("is_test"), ["essay_id"],
                             probabilities=True, penalty_c=penalty_c, **TIGHT)
    return scored.select("essay_id", F.posexplode("probability").alias("label", "p")).where(
        "label > 0").select("essay_id", "label", F.round("p", 3).alias("probability"))


@query("fitted_probabilities", "M1 M3 M10", probabilities_sql(0.0, 3000))
def fitted_probabilities(spark, folder):
    return _probabilities(spark, folder, None)


@query("penalised_probabilities", "M2 M3 M10", probabilities_sql(1 / PENALTY_C, 1000))
def penalised_probabilities(spark, folder):
    return _probabilities(spark, folder, PENALTY_C)


@query("saved_model_grades", "M3 M2", f"""
WITH RECURSIVE {solver(1 / PENALTY_C, 1000)}
SELECT essay_id, CASE WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END::BIGINT AS predicted
FROM graded""")
def saved_model_grades(spark, folder):
    """Models are saved, loaded in a session of its own and applied to rows they have not seen."""
    rows = rating_points(spark, folder)
    train = _train(assemble(rows, COLUMNS))
    path = fresh_path(spark, "saved-models")
    saved_models.save(fit_coefficients(train, penalty_c=PENALTY_C, **TIGHT),
                      saved_models.about_labels(train, "prompt_name", "score"), COLUMNS, "prompt_name", path)
    later = spark.newSession()
    new = rows.where("is_test").select("essay_id", "prompt_name", *COLUMNS)
    return saved_models.grade(saved_models.load(later, path), new, ["essay_id"])
