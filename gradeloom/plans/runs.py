"""Complete runs: baseline, main and experiment.

Every run takes essays with missing cells and returns ``prompt, model, metric, value`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.constants import (
    EXPERIMENT_SEED, MAX_ITER, NEIGHBOURS, SPLIT_SEED, TOP_N)
from gradeloom.operators import metrics
from gradeloom.operators.encode import encode, label_codes
from gradeloom.operators.features import FEATURES, add_features
from gradeloom.operators.grading import bell_curve_grades
from gradeloom.operators.impute import fill_missing
from gradeloom.operators.lexicon import keep_content_words
from gradeloom.operators.models import assemble, fit_and_predict, weighted_train
from gradeloom.operators.neighbours import nearest, vote
from gradeloom.operators.ngrams import token_table
from gradeloom.operators.similarity import prompt_tfidf, score_documents
from gradeloom.operators.split import class_weights, stratified_split
from gradeloom.sources.staging import stage, stage_by

# Columns left once id, target and text are dropped.
BASE_COLUMNS = [
    "essay_word_count", "assignment", "prompt_name", "grade_level", "economically_disadvantaged",
    "student_disability_status", "ell_status", "race_ethnicity", "gender"]
MAIN_COLUMNS = [*BASE_COLUMNS, *FEATURES, "similarity_score"]
SIMILARITIES = ["similarity", "nav_similarity", "dice", "jaccard", "tfidf"]
EXPERIMENT_COLUMNS = ["essay_word_count", *FEATURES, *SIMILARITIES]
NARROW_COLUMNS = ["similarity", "essay_word_count"]


@dataclass(frozen=True)
class Settings:
    models: Sequence[str] = ("logistic",)
    n: int = TOP_N
    test_size: float = 0.2
    seed: int = SPLIT_SEED
    max_iter: int = MAX_ITER
    penalty_c: float | None = None
    weighting: str = "exponential"
    alambda: float = 1.0
    k: int = NEIGHBOURS
    # Essays the frequent n-grams are drawn from: "all" of the prompt, or its "train" rows.
    fit_on: str = "all"
    # Divisor of the bell curve: "mean", or "std" for the deviation.
    spread: str = "mean"
    # Neighbours search scaled columns (zero mean, unit deviation per prompt) instead of plain ones.
    scale: bool = False
    # Keys that fill_missing sorts in place before its neighbour rules.
    sort_keys: Sequence[str] = ()
    # Add precision, recall and F1 of every class to the results.
    report: bool = False


EXPERIMENT = Settings(seed=EXPERIMENT_SEED, penalty_c=1.0)


def tfidf(tokens: DataFrame) -> DataFrame:
    """The reference's stub of a TF-IDF score, which is 1; the runs take ``prompt_tfidf``."""
    return tokens.select("doc_key", F.lit(1.0).alias("tfidf"))


def essay_tokens(essays: DataFrame) -> DataFrame:
    return token_table(essays, "essay_id", "full_text", "prompt_name", "row_id")


def filled_essays(essays: DataFrame, sort_keys: Sequence[str] = ()) -> DataFrame:
    return stage(fill_missing(essays, sort_keys), "essays")


def encoded_essays(filled: DataFrame) -> DataFrame:
    """Filled essays with category codes, without text."""
    return encode(filled.drop("full_text"), label_codes(filled))


def list_source(filled: DataFrame, settings: Settings) -> DataFrame | None:
    """Ids of the essays lists are drawn from; None for all.

    Split membership depends on id, prompt and score only, so it is known before features are.
    """
    if settings.fit_on == "all":
        return None
    split = stratified_split(filled.select("essay_id", "prompt_name", "score"),
                             test_size=settings.test_size, seed=settings.seed)
    return stage(
        split.where(~F.col("is_test")).select(F.col("essay_id").alias("doc_key")), "list_source")


def feature_table(filled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The ten features and the similarity score per essay, staged once for later runs."""
    scores = score_documents(
        essay_tokens(filled), settings.n, list_source(filled, settings)).select(
        F.col("doc_key").alias("essay_id"), F.col("similarity").alias("similarity_score"))
    features = add_features(filled.select("essay_id", "full_text")).drop("full_text")
    return stage_by(features.join(scores, "essay_id", "left"), "features", "essay_id")


def similarity_table(filled: DataFrame, lexicon: DataFrame,
                     settings: Settings = EXPERIMENT) -> DataFrame:
    """The five similarity columns per essay; TF-IDF is its cosine to the name of its prompt."""
    n, source = settings.n, list_source(filled, settings)
    tokens = stage_by(essay_tokens(filled), "tokens", "doc_key")
    plain = score_documents(tokens, n, source).select("doc_key", "similarity", "dice", "jaccard")
    content = score_documents(keep_content_words(tokens, lexicon), n, source).select(
        "doc_key", F.col("similarity").alias("nav_similarity"))
    names = stage(filled.select("prompt_name").distinct(), "prompts")
    prompts = token_table(names, *["prompt_name"] * 4)
    return plain.join(content, "doc_key").join(prompt_tfidf(tokens, prompts, source), "doc_key").select(
        F.col("doc_key").alias("essay_id"), *SIMILARITIES)


def scores_of(predictions: DataFrame, weights: DataFrame | None, model: str,
              by: Sequence[str] = ("prompt_name",), report: bool = False) -> DataFrame:
    """The metrics and the grade distribution of a prediction table, in long form.

    Kappa and weighted accuracy need ``weights``; models that are graded without them leave both
    out. Rows without a prediction are not scored but counted as ``ungraded``.
    """
    by = list(by)
    counts = stage(metrics.confusion(predictions, by), "confusion")
    missing = counts.where("predicted IS NULL").groupBy(*by).agg(
        F.sum("rows").cast("double").alias("ungraded"))
    counts = counts.where("predicted IS NOT NULL")
    parts = [metrics.evaluate(counts, by, counted=True), missing]
    if weights is not None:
        parts += [metrics.quadratic_weighted_kappa(counts, by, counted=True),
                  metrics.weighted_accuracy(counts, by, weights, counted=True)]
    rows = [metrics.long_metrics(part, by) for part in parts]
    grades = metrics.grade_distribution(counts, by, counted=True)
    for side in ("predicted", "actual"):
        rows.append(grades.where(F.col(side).isNotNull()).select(
            *by, F.concat(F.lit(f"{side}_"), F.col("grade").cast("string")).alias("metric"),
            F.col(side).cast("double").alias("value")))
    if report:
        classes = metrics.class_report(counts, by, counted=True)
        long = metrics.long_metrics(classes, [*by, "label"])
        rows.append(long.select(*by, F.concat_ws(
            "_", "metric", F.col("label").cast("string")).alias("metric"), "value"))
    long = reduce(DataFrame.unionByName, rows)
    return long.select(F.col(by[0]).cast("string").alias("prompt"), F.lit(model).alias("model"),
                       "metric", "value")


def scaled(frame: DataFrame, columns: Sequence[str], by: str = "prompt_name") -> DataFrame:
    """``columns`` less their mean over their deviation among the training rows of each prompt."""
    known = frame.where(~F.col("is_test"))
    stats = stage(known.groupBy(F.col(by).alias("_by")).agg(
        *(f(F.col(c).cast("double")).alias(f"_{name}_{c}") for c in columns
          for name, f in (("mean", F.avg), ("dev", F.stddev_pop)))), "scales")
    joined = frame.join(stats, F.col(by) == F.col("_by"), "left")
    values = {c: F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"_mean_{c}"),
                                         F.col(f"_dev_{c}")), F.lit(0.0)) for c in columns}
    return joined.select(*(values.get(c, F.col(c)).alias(c) for c in frame.columns))


def grade_models(frame: DataFrame, columns: Sequence[str], settings: Settings,
                 label: str, similarity: str | None = None) -> DataFrame:
    """Split, weigh, fit and evaluate each chosen model on an encoded frame."""
    split = stage(stratified_split(
        frame, test_size=settings.test_size, seed=settings.seed), "split")
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    weights = stage(class_weights(train, scheme=settings.weighting), "weights")
    keep = ["essay_id", "prompt_name", "score"]
    results = []
    if "bell" in settings.models:
        graded = bell_curve_grades(split, ["prompt_name"], similarity, settings.alambda,
                                   spread=settings.spread)
        graded = stage(graded.select(*keep, F.col("grade").alias("predicted")), "graded")
        results.append(scores_of(graded, None, f"{label}_bell", report=settings.report))
    if "logistic" in settings.models:
        # The prompt is both the key of a model and one of its columns.
        rows = assemble(
            split.withColumn("_prompt", F.col("prompt_name")), columns).select(
            F.col("_prompt").alias("prompt_name"), "essay_id", "score", "is_test", "vector")
        known = stage(weighted_train(
            rows.where(~F.col("is_test")), "prompt_name", "score", settings.weighting), "train")
        predicted = fit_and_predict(
            known, rows.where("is_test"), keep, penalty_c=settings.penalty_c,
            max_iter=settings.max_iter)
        results.append(scores_of(predicted, weights, f"{label}_logistic", report=settings.report))
    if "neighbours" in settings.models:
        space = split.withColumn("_part", F.col("prompt_name").cast("string"))
        if settings.scale:
            space = scaled(space, columns, "_part")
        space = space.select(
            F.col("_part").alias("part"), F.col("essay_id").alias("id"), "is_test",
            F.array(*(F.col(c).cast("double") for c in columns)).alias("features"))
        found = nearest(space.where("is_test").drop("is_test"),
                        space.where(~F.col("is_test")).drop("is_test"), settings.k)
        labels = train.select(F.col("essay_id").alias("id"), F.col("score").alias("label"))
        voted = vote(found, labels).withColumnRenamed("query", "essay_id")
        predicted = stage(test.select(*keep).join(
            voted.select("essay_id", "predicted"), "essay_id", "left"), "predicted")
        results.append(scores_of(predicted, None, f"{label}_neighbours", report=settings.report))
    return reduce(DataFrame.unionByName, results)


def with_features(encoded: DataFrame, given: DataFrame) -> DataFrame:
    """``encoded`` with the columns of ``given`` by essay_id; an essay without a row fails the job."""
    given = given.withColumn("_given", F.lit(True))
    checked = F.when(F.col("_given"), F.col("essay_id")).otherwise(F.raise_error(F.concat(
        F.lit("no features for essay "), F.coalesce(F.col("essay_id").cast("string"), F.lit("null")))))
    return encoded.join(given, "essay_id", "left").withColumn("essay_id", checked).drop("_given")


def baseline_run(essays: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Logistic regression on the columns that need no text."""
    encoded = encoded_essays(filled_essays(essays, settings.sort_keys))
    return grade_models(stage(encoded, "encoded"), BASE_COLUMNS, settings, "base")


def main_run(essays: DataFrame, settings: Settings = Settings(),
             features: DataFrame | None = None) -> DataFrame:
    """Baseline, then the chosen models with text features and similarity score.

    ``features`` is a ready table of essay_id, the ten features and similarity_score, with a row for
    every essay; without it they are computed.
    """
    filled = filled_essays(essays, settings.sort_keys)
    encoded = stage_by(encoded_essays(filled), "encoded", "essay_id")
    base = grade_models(encoded, BASE_COLUMNS, Settings(
        test_size=settings.test_size, seed=settings.seed, max_iter=settings.max_iter), "base")
    if features is None:
        features = feature_table(filled, settings)
    given = features.select("essay_id", *FEATURES, "similarity_score")
    full = stage(with_features(encoded, given), "full")
    return base.unionByName(
        grade_models(full, MAIN_COLUMNS, settings, "main", "similarity_score"))


def experiment_run(essays: DataFrame, lexicon: DataFrame, settings: Settings = EXPERIMENT,
                   columns: Sequence[str] = EXPERIMENT_COLUMNS,
                   features: DataFrame | None = None) -> DataFrame:
    """Word count, text features and the five similarity columns, penalised regression.

    ``features`` is a ready table of essay_id and the ten features, with a row for every essay;
    without it they are computed.
    """
    filled = filled_essays(essays, settings.sort_keys)
    if features is None:
        features = add_features(filled.select("essay_id", "full_text")).drop("full_text")
    given = features.select("essay_id", *FEATURES)
    frame = with_features(encoded_essays(filled), given).join(
        similarity_table(filled, lexicon, settings), "essay_id")
    return grade_models(stage(frame, "full"), columns, settings, "experiment", "similarity")
