import math

import pytest
from pyspark.sql import functions as F

from gradeloom.catalog.similarity import document_tokens, tagged_tokens
from gradeloom.operators.lexicon import build_lexicon
from gradeloom.operators.ngrams import doc_ngrams
from gradeloom.plans import runs
from gradeloom.sources.essays import essay_view
from gradeloom.sources.staging import stage, stage_by

QUICK = dict(max_iter=20, n=50)
METRICS = {"accuracy", "precision", "recall", "f1_score"}
AGREEMENT = {"kappa", "weighted_accuracy"}


def check(results, models):
    rows = results.collect()
    assert results.columns == ["prompt", "model", "metric", "value"]
    assert {r.model for r in rows} == models
    for model in models:
        seen = {r.metric for r in rows if r.model == model}
        assert METRICS <= seen and (AGREEMENT <= seen) == model.endswith("logistic")
        for prompt in {r.prompt for r in rows}:
            mine = {r.metric: r.value for r in rows if (r.prompt, r.model) == (prompt, model)}
            assert 0 <= mine["accuracy"] <= 1 and mine.get("kappa", 0) <= 1
            assert sum(v for m, v in mine.items() if m.startswith("predicted_")) == sum(
                v for m, v in mine.items() if m.startswith("actual_"))


def test_main_run(spark, folder):
    settings = runs.Settings(models=("bell", "logistic", "neighbours"), **QUICK)
    check(runs.main_run(essay_view(spark, folder), settings),
          {"base_logistic", "main_bell", "main_logistic", "main_neighbours"})


@pytest.mark.parametrize("columns,fit_on", [
    (runs.EXPERIMENT_COLUMNS, "all"), (runs.NARROW_COLUMNS, "train")])
def test_experiment_run(spark, folder, columns, fit_on):
    lexicon = stage(build_lexicon(tagged_tokens(document_tokens(spark, folder))), "lexicon")
    settings = runs.Settings(seed=7362, penalty_c=1.0, fit_on=fit_on, **QUICK)
    check(runs.experiment_run(essay_view(spark, folder), lexicon, settings, columns),
          {"experiment_logistic"})


def test_tfidf_of_the_experiment_is_the_cosine_to_the_prompt(spark):
    words = {1: ["phones", "distract", "phones"], 2: ["driving", "phones"], 3: ["red"], 4: ["planet", "phones"]}
    rows = [(i, i, " ".join(words.get(i, ())), "Phones and driving" if i < 4 else "Red planet") for i in range(1, 6)]
    filled = stage(spark.createDataFrame(
        [*rows, (6, 6, "red", None)], "essay_id bigint, row_id bigint, full_text string, prompt_name string"), "filled")
    lexicon = spark.createDataFrame([("phones", "NOUN")], "token string, tag string")
    got = {r.essay_id: r.tfidf for r in runs.similarity_table(filled, lexicon).collect()}
    own = [*(words[i] if i in words else [] for i in range(1, 6)), ["red"]]

    def weights(tokens):
        return {t: tokens.count(t) * (math.log(7 / (1 + sum(t in o for o in own))) + 1) for t in tokens}

    def cosine(a, b):
        a, b = weights(a), weights(b)
        return sum(v * b.get(t, 0) for t, v in a.items()) / math.hypot(*a.values()) / math.hypot(*b.values())

    prompts = {i: ["phones", "driving"] if i < 4 else ["red", "planet"] for i in words}
    assert got == pytest.approx({**{i: cosine(words[i], prompts[i]) for i in words}, 5: 0, 6: 0})
    assert got[1] not in (0, 1) and got[3] == 0


def test_sixteen_experiment_columns():
    assert len(runs.EXPERIMENT_COLUMNS) == 16 and len(runs.BASE_COLUMNS) == 9


def test_missing_grades_are_counted(spark):
    rows = [("p", 1, 1), ("p", 2, None), ("q", 3, 3), ("q", 4, None)]
    df = spark.createDataFrame(rows, "prompt_name string, score bigint, predicted bigint")
    got = {(r.prompt, r.metric): r.value for r in runs.scores_of(df, None, "m", report=True).collect()}
    assert got["p", "ungraded"] == got["q", "ungraded"] == 1 and got["p", "accuracy"] == 1
    assert got["q", "f1_score_3"] == 1 and ("p", "kappa") not in got


def test_ready_features_are_used(spark, folder):
    essays = essay_view(spark, folder)
    settings = runs.Settings(**QUICK)
    features = runs.feature_table(runs.filled_essays(essays), settings)
    # Other values in the table lead to other grades than computing them.
    same = {tuple(r) for r in runs.main_run(essays, settings, features).collect()}
    assert same == {tuple(r) for r in runs.main_run(essays, settings).collect()}
    flat = features.withColumns({c: F.col(c) * 0 for c in features.columns if c != "essay_id"})
    assert same != {tuple(r) for r in runs.main_run(essays, settings, flat).collect()}


def test_run_options(spark, folder):
    settings = runs.Settings(models=("bell", "neighbours"), spread="std", scale=True, report=True,
                             sort_keys=("grade_level", "prompt_name"), **QUICK)
    rows = runs.main_run(essay_view(spark, folder), settings).collect()
    assert any(r.metric.startswith("support_") for r in rows if r.model == "main_neighbours")


def test_essays_without_features_fail_the_run(spark):
    essays = spark.createDataFrame([(1, 3), (2, 4)], "essay_id bigint, score bigint")
    given = spark.createDataFrame([(1, .5)], "essay_id bigint, similarity_score double")
    assert [tuple(r) for r in runs.with_features(essays.where("essay_id = 1"), given).collect()] == [
        (1, 3, .5)]
    with pytest.raises(Exception, match="no features for essay 2"):
        runs.with_features(essays, given).collect()


def test_staged_tables_meet_without_an_exchange(spark, folder, many_tasks):
    """Even where nothing may be broadcast."""
    def exchanges(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange")

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        essays = essay_view(spark, folder)
        filled = runs.filled_essays(essays)
        features = runs.feature_table(filled, runs.Settings(**QUICK))
        encoded = stage_by(runs.encoded_essays(filled), "encoded", "essay_id")
        full = runs.with_features(encoded, features)
        assert exchanges(full) == 0 and full.count() == filled.count()
        tokens = stage_by(runs.essay_tokens(filled), "tokens", "doc_key")
        grams = doc_ngrams(tokens)
        assert exchanges(grams) == 0
        assert sorted(map(tuple, grams.collect()), key=repr) == sorted(
            map(tuple, doc_ngrams(runs.essay_tokens(filled)).collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
