"""Fitted models as tables that outlive the run that fitted them.

A saved set of models is one folder: ``models`` has a row per prompt with its coefficients, the rows it
was fitted on and the labels it has seen, ``about`` one row with the feature columns in order and the
name of the key column. Any session that reaches the folder scores new rows with it. A set is written
under a new version and becomes current by its ``about`` row, which is written last, so readers
never meet half a set.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators.models import assemble, score_rows

UNSEEN = ("null", "pooled", "fail")
# Key of the model that stands in for prompts without one.
POOLED = "*"


class Models(NamedTuple):
    """A loaded set: coefficients by prompt, the feature columns and the name of the key."""

    classes: DataFrame
    columns: list[str]
    prompt: str


def about_labels(train: DataFrame, prompt: str, label: str) -> DataFrame:
    """Rows and labels that each prompt's model was fitted on."""
    return train.groupBy(F.col(prompt).cast("string").alias("prompt")).agg(
        F.count(F.lit(1)).alias("rows"), F.sort_array(F.collect_set(F.col(label).cast("int"))).alias("labels"))


def save(classes: DataFrame, seen: DataFrame, columns: Sequence[str], prompt: str,
         path: str) -> None:
    """Write ``classes`` (see ``models.fit_coefficients``) and what they were fitted on to ``path``.

    ``seen`` comes from ``about_labels``. Saving again replaces the current set; sets in use by
    readers stay readable.
    """
    spark, version = classes.sparkSession, uuid.uuid4().hex
    named = classes.select(F.col(prompt).cast("string").alias("prompt"), "classes")
    named.join(seen, "prompt", "left").write.parquet(f"{path}/models/{version}")
    about = spark.range(1).select(
        F.lit(version).alias("version"), F.lit(prompt).alias("key"),
        F.array(*map(F.lit, columns)).alias("columns"), F.current_timestamp().alias("saved"))
    about.coalesce(1).write.mode("append").parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> Models:
    """The set that was saved last."""
    about = spark.read.parquet(f"{path}/about").orderBy(F.desc("saved"), "version").first()
    models = spark.read.parquet(f"{path}/models/{about['version']}")
    return Models(models, list(about["columns"]), about["key"])


def grade(models: Models, rows: DataFrame, keep: Sequence[str], unseen: str = "null",
          probabilities: bool = False) -> DataFrame:
    """``keep`` columns with ``predicted`` (and ``probability``) for new rows.

    ``unseen`` says what becomes of prompts without a model: their rows get a null grade, the
    grade of the model saved under ``POOLED``, or fail the job. Labels that a prompt's model has not
    seen have no probability mass to speak of: they are never predicted and their probability is 0.
    Missing feature columns are an error when planned; null features give a null grade.
    """
    if unseen not in UNSEEN:
        raise ValueError(f"unseen must be one of {', '.join(UNSEEN)}")
    missing = [c for c in models.columns if c not in rows.columns]
    if missing:
        raise ValueError(f"rows lack the feature columns {', '.join(missing)}")
    given = F.col(models.prompt).cast("string")
    known = models.classes.select(F.col("prompt").alias("_model"))
    keyed = rows.join(known, given == F.col("_model"), "left")
    if unseen == "pooled":
        keyed = keyed.withColumn("_model", F.coalesce("_model", F.lit(POOLED)))
    elif unseen == "fail":
        keyed = keyed.withColumn("_model", F.coalesce("_model", F.raise_error(F.concat(
            F.lit("no model for prompt "), F.coalesce(given, F.lit("null")))).cast("string")))
    # Features get names of their own, so the columns of the rows stay as they are.
    features = [f"_feature{i}" for i in range(len(models.columns))]
    whole = F.lit(True)
    for c in models.columns:
        whole = whole & F.col(c).isNotNull()
    filled = keyed.withColumn("_model", F.when(whole, F.col("_model"))).withColumns({
        f: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for f, c in zip(features, models.columns)})
    classes = models.classes.select(
        F.col("prompt").alias("_model"), "classes", F.col("labels").alias("_labels"))
    scored = score_rows(classes, assemble(filled, features, "_vector"), [*keep, "_labels"], "_model",
                        probabilities, "_vector")
    if not probabilities:
        return scored.select(*keep, "predicted")
    masked = F.transform("probability", lambda p, i: F.when(
        F.array_contains("_labels", i.cast("int")), p).otherwise(0.0))
    total = F.aggregate("_masked", F.lit(0.0), lambda a, b: a + b)
    return scored.withColumn("_masked", masked).select(
        *keep, "predicted", F.transform("_masked", lambda p: p / total).alias("probability"))
