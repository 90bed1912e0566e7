"""Sources, projections, imputation, encoding and splits over the essay view."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.functions.constants import ENCODED
from gradeloom.operators import impute as im
from gradeloom.operators.encode import encode, label_codes
from gradeloom.operators.profile import numeric_columns
from gradeloom.operators.ranking import number_rows
from gradeloom.operators.split import class_weights, stratified_split, under_sample
from gradeloom.plans.runs import NARROW_COLUMNS, essay_tokens, feature_table, filled_essays
from gradeloom.operators.similarity import score_documents
from gradeloom.sources import essays as es
from gradeloom.sources.staging import fresh_path, stage
from gradeloom.sources.tables import table

ALL = ", ".join(sql.ESSAY_COLUMNS)


def kept_essays(spark, folder):
    essays = im.drop_missing(es.essay_view(spark, folder), ["full_text"])
    return essays.select("row_id", "assignment", "prompt_name", "grade_level")


def prompted(spark, folder):
    essays = im.drop_missing(es.essay_view(spark, folder), ["full_text", "prompt_name"])
    return stage(essays.select("essay_id", "prompt_name", "score"), "prompted")


PROMPTED = """
prompted AS (SELECT essay_id, prompt_name, score FROM essays
             WHERE full_text IS NOT NULL AND prompt_name IS NOT NULL)"""
SPLIT = sql.with_(sql.SCORED, sql.ESSAYS, PROMPTED, sql.split("prompted"), sql.WEIGHTS)


@query("csv_scan", "S1", sql.ESSAY + f"SELECT {ALL} FROM essays")
def csv_scan(spark, folder):
    path = fresh_path(spark, "essays-csv")
    essays = es.essay_view(spark, folder)
    es.write_essays_csv(essays.select(*sorted(essays.columns)), path)
    return es.read_essays_csv(spark, path)


@query("essay_table", "S1", sql.ESSAY + f"SELECT {ALL} FROM essays")
def essay_table(spark, folder):
    return es.essay_view(spark, folder)


@query("head_preview", "S4", sql.ESSAY + """
SELECT essay_id, score, prompt_name, essay_word_count FROM essays ORDER BY row_id LIMIT 3""")
def head_preview(spark, folder):
    return es.essay_view(spark, folder).orderBy("row_id").limit(3).select(
        "essay_id", "score", "prompt_name", "essay_word_count")


@query("required_text", "P1", sql.ESSAY + """
SELECT essay_id, score FROM essays WHERE full_text IS NOT NULL""")
def required_text(spark, folder):
    return im.drop_missing(es.essay_view(spark, folder), ["full_text"]).select("essay_id", "score")


@query("complete_rows", "P2", sql.ESSAY + "SELECT essay_id, score FROM essays WHERE "
       + " AND ".join(f"{c} IS NOT NULL" for c in sql.ESSAY_COLUMNS))
def complete_rows(spark, folder):
    return im.drop_missing(es.essay_view(spark, folder)).select("essay_id", "score")


@query("one_prompt", "P3", sql.ESSAY + """
SELECT essay_id, score, essay_word_count FROM essays WHERE prompt_name = 'en'""")
def one_prompt(spark, folder):
    return es.essay_view(spark, folder).where(F.col("prompt_name") == "en").select(
        "essay_id", "score", "essay_word_count")


@query("base_columns", "P4", sql.ESSAY + """
SELECT essay_word_count, assignment, prompt_name, grade_level, economically_disadvantaged,
  student_disability_status, ell_status, race_ethnicity, gender FROM essays""")
def base_columns(spark, folder):
    return es.essay_view(spark, folder).drop("essay_id", "row_id", "score", "full_text")


@query("narrow_columns", "P4b J6", sql.with_(
    sql.FILLED, sql.tokens("filled", "essay_id", "full_text", "prompt_name", "row_id"),
    sql.grams(), sql.top(), sql.matched()) + """
SELECT f.essay_id, m.hits::DOUBLE / m.list_size AS similarity, f.essay_word_count
FROM filled f JOIN matched m ON m.doc_key = f.essay_id""")
def narrow_columns(spark, folder):
    filled = filled_essays(es.essay_view(spark, folder))
    scores = score_documents(essay_tokens(filled)).withColumnRenamed("doc_key", "essay_id")
    return filled.join(scores, "essay_id").select("essay_id", *NARROW_COLUMNS)


@query("missing_masks", "P5", sql.ESSAY + """
SELECT essay_id, assignment IS NULL AS no_assignment, prompt_name IS NULL AS no_prompt,
  grade_level IS NULL AS no_grade FROM essays
WHERE assignment IS NULL OR prompt_name IS NULL OR grade_level IS NULL""")
def missing_masks(spark, folder):
    masks = {"no_assignment": "assignment", "no_prompt": "prompt_name", "no_grade": "grade_level"}
    essays = es.essay_view(spark, folder)
    flagged = essays.select("essay_id", *(F.isnull(c).alias(m) for m, c in masks.items()))
    return flagged.where("no_assignment or no_prompt or no_grade")


@query("numeric_projection", "P6", "SELECT event_id, user_id, value FROM events")
def numeric_projection(spark, folder):
    events = table(spark, folder, "events")
    return events.select(*numeric_columns(events))


@query("dense_index", "P7", sql.ESSAY + """
SELECT essay_id, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM essays
WHERE full_text IS NOT NULL""")
def dense_index(spark, folder):
    kept = im.drop_missing(es.essay_view(spark, folder), ["full_text"])
    return number_rows(kept.select("essay_id", "row_id"), [], ["row_id"], rank="idx").select(
        "essay_id", "idx")


def _placed_sql(columns):
    return sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT, sql.placed("kept", columns, "placed_once"))


@query("neighbour_agreement", "W1", _placed_sql(["assignment", "prompt_name"]) + """
SELECT row_id, coalesce(above_assignment = below_assignment, false) AS same_assignment,
  coalesce(above_prompt_name = below_prompt_name, false) AS same_prompt FROM placed_once""")
def neighbour_agreement(spark, folder):
    placed = im.nearest_known(
        im.in_slices(kept_essays(spark, folder), "row_id"), "row_id", ["assignment", "prompt_name"])
    return placed.select(
        "row_id", im.same_above_below("assignment").alias("same_assignment"),
        im.same_above_below("prompt_name").alias("same_prompt"))


NEIGHBOURS = sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT, sql.NEIGHBOUR_FILL)


@query("filled_assignments", "W2", NEIGHBOURS + """
SELECT row_id, assignment, prompt_name FROM filled_once""")
def filled_assignments(spark, folder):
    placed = im.nearest_known(
        im.in_slices(kept_essays(spark, folder), "row_id"), "row_id", ["assignment", "prompt_name"])
    return im.fill_assignment(placed).select("row_id", "assignment", "prompt_name")


@query("filled_prompts", "W3", NEIGHBOURS + """
SELECT row_id, assignment, prompt_name, grade_level FROM filled_twice""")
def filled_prompts(spark, folder):
    return im.fill_neighbours(kept_essays(spark, folder))


@query("filled_grades", "W4", sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT) + """
SELECT row_id, last_value(grade_level IGNORE NULLS) OVER (ORDER BY row_id) AS grade_level
FROM kept""")
def filled_grades(spark, folder):
    return im.fill_forward(
        kept_essays(spark, folder).select("row_id", "grade_level"), "row_id", "grade_level")


@query("sorted_in_place", "W5", sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT) + """
SELECT k.row_id, k.grade_level, coalesce(m.slot, k.row_id) AS slot FROM kept k LEFT JOIN (
  SELECT a.row_id, b.slot FROM
    (SELECT row_id, row_number() OVER (ORDER BY grade_level, row_id) AS r FROM kept
     WHERE grade_level IS NOT NULL) a JOIN
    (SELECT row_id AS slot, row_number() OVER (ORDER BY row_id) AS r FROM kept
     WHERE grade_level IS NOT NULL) b USING (r)) m ON m.row_id = k.row_id""")
def sorted_in_place(spark, folder):
    kept = stage(kept_essays(spark, folder).select("row_id", "grade_level"), "kept")
    return im.sorted_in_place(kept, "grade_level", "row_id")


@query("filled_in_sorted_order", "W5 I1", sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT) + """
, placed AS (SELECT k.*, coalesce(m.slot, k.row_id) AS slot FROM kept k LEFT JOIN (
  SELECT a.row_id, b.slot FROM
    (SELECT row_id, row_number() OVER (ORDER BY grade_level, row_id) AS r FROM kept
     WHERE grade_level IS NOT NULL) a JOIN
    (SELECT row_id AS slot, row_number() OVER (ORDER BY row_id) AS r FROM kept
     WHERE grade_level IS NOT NULL) b USING (r)) m ON m.row_id = k.row_id)
SELECT row_id, coalesce(grade_level, last_value(grade_level IGNORE NULLS) OVER (
    ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS grade_level
FROM placed""")
def filled_in_sorted_order(spark, folder):
    kept = stage(kept_essays(spark, folder), "kept")
    placed = im.sorted_in_place(kept, "grade_level", "row_id").withColumn(
        "_own", F.col("row_id")).withColumn("row_id", F.col("slot")).drop("slot")
    placed = stage(placed, "placed")
    filled = im.fill_neighbours(placed.drop("_own")).select("row_id", "grade_level")
    return filled.join(placed.select("row_id", "_own"), "row_id").select(
        F.col("_own").alias("row_id"), "grade_level")


@query("coin_filled", "I2", sql.with_(sql.SCORED, sql.ESSAYS, sql.coins("essays", "coined")) + """
SELECT essay_id, economically_disadvantaged, student_disability_status, ell_status, gender
FROM coined""")
def coin_filled(spark, folder):
    return im.fill_by_coin(es.essay_view(spark, folder)).select(
        "essay_id", "economically_disadvantaged", "student_disability_status", "ell_status",
        "gender")


@query("observed_filled", "I3", sql.with_(
    sql.SCORED, sql.ESSAYS, sql.observed("essays", "observed")) + """
SELECT essay_id, race_ethnicity FROM observed""")
def observed_filled(spark, folder):
    essays = es.essay_view(spark, folder).select("essay_id", "race_ethnicity")
    return im.fill_from_observed(essays, "race_ethnicity")


@query("filled_essays", "I1", sql.with_(sql.FILLED) + f"SELECT {ALL} FROM filled")
def all_filled(spark, folder):
    return im.fill_missing(es.essay_view(spark, folder))


CODES = "codes AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", dense_rank() OVER (ORDER BY {c}) - 1 AS code, {c} AS label "
    f"FROM (SELECT DISTINCT {c} FROM filled)" for c in ENCODED) + ")"


@query("category_codes", "I5", sql.with_(sql.FILLED, CODES) + """
SELECT "column", code, label FROM codes""")
def category_codes(spark, folder):
    return label_codes(im.fill_missing(es.essay_view(spark, folder)))


@query("encoded_essays", "I4 J4", sql.with_(sql.FILLED) + "SELECT essay_id, score, " + ", ".join(
    f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in ENCODED) + " FROM filled")
def encoded(spark, folder):
    filled = filled_essays(es.essay_view(spark, folder)).select("essay_id", "score", *ENCODED)
    return encode(filled, label_codes(filled))


@query("event_codes", "I4 I5", """
SELECT event_id, dense_rank() OVER (ORDER BY event_type) - 1 AS event_type FROM events""")
def event_codes(spark, folder):
    events = table(spark, folder, "events").select("event_id", "event_type")
    return encode(events, label_codes(events, ["event_type"]), ["event_type"])


@query("stratified_split", "W7", SPLIT + """
SELECT essay_id, prompt_name, score, is_test FROM split""")
def split(spark, folder):
    return stratified_split(prompted(spark, folder))


@query("experiment_split", "W7", sql.with_(
    sql.SCORED, sql.ESSAYS, PROMPTED, sql.split("prompted", seed=7362)) + """
SELECT essay_id, is_test FROM split""")
def experiment_split(spark, folder):
    return stratified_split(prompted(spark, folder), seed=7362).select("essay_id", "is_test")


@query("class_weights", "A5", SPLIT + """
SELECT prompt_name, score, n AS rows, round(weight, 9) AS weight FROM weights""")
def exponential_weights(spark, folder):
    train = stratified_split(prompted(spark, folder)).where(~F.col("is_test"))
    return class_weights(train).withColumn("weight", F.round("weight", 9))


@query("alternative_weights", "A6", SPLIT + """
SELECT prompt_name, score, n AS rows,
  round(sum(n) OVER p::DOUBLE / (count(*) OVER p * n), 9) AS balanced,
  round(sqrt(sum(n) OVER p::DOUBLE / n), 9) AS root
FROM weights WINDOW p AS (PARTITION BY prompt_name)""".replace("OVER p::", "OVER p ::"))
def alternative_weights(spark, folder):
    train = stage(stratified_split(prompted(spark, folder)).where(~F.col("is_test")), "train")
    balanced = class_weights(train, scheme="balanced").withColumn(
        "balanced", F.round("weight", 9)).drop("weight")
    root = class_weights(train, scheme="root").select(
        "prompt_name", "score", F.round("weight", 9).alias("root"))
    return balanced.join(root, ["prompt_name", "score"])


@query("under_sampled", "I6", sql.with_(sql.SCORED, sql.ESSAYS, PROMPTED) + """
, sizes AS (SELECT *, min(n) OVER (PARTITION BY prompt_name) AS smallest FROM (
    SELECT prompt_name, score, count(*) AS n FROM prompted GROUP BY ALL))
SELECT essay_id, prompt_name, score FROM (
  SELECT p.*, s.smallest, row_number() OVER (PARTITION BY p.prompt_name, p.score
    ORDER BY md5(concat(p.essay_id, '|42')), p.essay_id) AS r
  FROM prompted p JOIN sizes s ON s.prompt_name = p.prompt_name AND s.score = p.score)
WHERE r <= smallest""")
def under_sampled(spark, folder):
    return under_sample(prompted(spark, folder), "essay_id", "prompt_name", "score")


FEATURE_SQL = sql.with_(
    sql.FILLED, sql.tokens("filled", "essay_id", "full_text", "prompt_name", "row_id"),
    sql.grams(), sql.top(), sql.matched())


@query("feature_scan", "S2", FEATURE_SQL + f"""
SELECT f.essay_id,
  ((length(full_text) - length(replace(full_text, ',', ''))))::BIGINT AS num_commas,
  ((length(full_text) - length(replace(full_text, '.', ''))))::BIGINT AS num_periods,
  len(regexp_extract_all(lower(full_text), '[{sql.WORD}]+'))::BIGINT AS words_seen,
  m.hits::DOUBLE / m.list_size AS similarity_score
FROM filled f JOIN matched m ON m.doc_key = f.essay_id""")
def feature_scan(spark, folder):
    filled = filled_essays(es.essay_view(spark, folder))
    features = feature_table(filled)
    from gradeloom.functions.text import word_run_count
    words = filled.select("essay_id", word_run_count(F.col("full_text")).alias("words_seen"))
    return features.join(words, "essay_id").select(
        "essay_id", "num_commas", "num_periods", "words_seen", "similarity_score")
