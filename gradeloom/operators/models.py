"""Multinomial logistic regression, one model per prompt.

Training rows are written partitioned by prompt, so the fit of a prompt reads that prompt's files
only, in as many tasks as they have splits. Models become rows of coefficients, and all rows of all
prompts are scored in one pass by a join on the prompt.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from itertools import batched

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from gradeloom.functions.constants import MAX_ITER
from gradeloom.operators.split import class_weights
from gradeloom.sources.staging import fresh_path, settle

# Fits submitted at the same time.
PARALLEL_FITS = 8
PART = "_part"


def assemble(df: DataFrame, columns: Sequence[str], out: str = "vector") -> DataFrame:
    cast = df.withColumns({c: F.col(c).cast("double") for c in columns})
    return VectorAssembler(inputCols=list(columns), outputCol=out).transform(cast)


def weighted_train(train: DataFrame, prompt: str, label: str, scheme: str) -> DataFrame:
    weights = settle(class_weights(train, prompt, label, scheme), "weights")
    return train.join(weights.select(prompt, label, "weight"), [prompt, label], "left")


def by_prompt(train: DataFrame, prompt: str) -> DataFrame:
    """``train`` written with one folder per prompt; a large prompt is split over several files."""
    spark, path = train.sparkSession, fresh_path(train.sparkSession, "by-prompt")
    keyed = train.withColumn(PART, F.col(prompt).cast("string"))
    keyed.hint("rebalance", F.col(PART)).write.partitionBy(PART).parquet(path)
    return spark.read.schema(keyed.schema).parquet(path)


def prompt_sizes(train: DataFrame, prompt: str) -> Iterator[Row]:
    """Weight and rows per prompt, read prompt by prompt."""
    return train.groupBy(prompt).agg(
        F.sum("weight").alias("total"), F.count(F.lit(1)).alias("rows")).orderBy(
        prompt).toLocalIterator()


def fit_prompts(train: DataFrame, prompt: str = "prompt_name", label: str = "score",
                vector: str = "vector", penalty_c: float | None = None,
                max_iter: int = MAX_ITER, tol: float = 1e-4,
                sizes: Iterable[Row] | None = None) -> dict[object, LogisticRegressionModel]:
    """A model per prompt from rows with ``weight``; fits run side by side, each distributed.

    ``penalty_c`` is the inverse L2 strength against the weighted loss sum; the estimator
    averages the loss over the weights, hence the regularisation 1 / (C * sum of weights).
    """
    def fit(row):
        estimator = LogisticRegression(
            family="multinomial", featuresCol=vector, labelCol=label, weightCol="weight",
            predictionCol="prediction", maxIter=max_iter, tol=tol,
            standardization=penalty_c is None,
            regParam=0.0 if penalty_c is None else 1.0 / (penalty_c * row["total"]))
        mine = F.col(PART) == str(row[prompt]) if PART in train.columns else (
            F.col(prompt) == row[prompt])
        return row[prompt], estimator.fit(train.where(mine))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        return dict(pool.map(fit, prompt_sizes(train, prompt) if sizes is None else sizes))


def coefficient_rows(spark: SparkSession, models: dict[object, LogisticRegressionModel],
                     prompt: T.StructField) -> DataFrame:
    """The prompt's key and ``classes``: per class its coefficients, the intercept last."""
    rows = [(key, [[*map(float, w), float(b)] for w, b in
                   zip(m.coefficientMatrix.toArray(), m.interceptVector.toArray())])
            for key, m in models.items()]
    schema = T.StructType([prompt, T.StructField("classes", T.ArrayType(T.ArrayType(T.DoubleType())))])
    return spark.createDataFrame(rows, schema)


def _margin(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)


def score_rows(classes: DataFrame, rows: DataFrame, keep: Sequence[str], prompt: str,
               probabilities: bool = False, vector: str = "vector") -> DataFrame:
    """``keep`` columns with ``predicted`` (and ``probability``); null without a model.

    One pass over ``rows``: the coefficients have one row per prompt.
    """
    known = classes.withColumnRenamed(prompt, "_key")
    found = rows.join(known, F.col(prompt) == F.col("_key"), "left").withColumn(
        "_x", F.concat(vector_to_array(vector), F.array(F.lit(1.0)))).withColumn(
        "_margins", F.transform("classes", lambda w: _margin(w, F.col("_x")))).withColumn(
        "_top", F.array_max("_margins"))
    best = (F.array_position("_margins", F.col("_top")) - 1).cast("bigint").alias("predicted")
    if not probabilities:
        return found.select(*keep, best)
    # A prompt with one label has an infinite margin for it.
    raised = F.transform("_margins", lambda m: F.when(
        m == F.col("_top"), 1.0).otherwise(F.exp(m - F.col("_top"))))
    found = found.withColumn("_raised", raised).withColumn(
        "_sum", F.aggregate("_raised", F.lit(0.0), lambda a, b: a + b))
    return found.select(*keep, best, F.transform(
        "_raised", lambda v: v / F.col("_sum")).alias("probability"))


def predict(models: dict[object, LogisticRegressionModel], rows: DataFrame, keep: Sequence[str],
            prompt: str = "prompt_name", probabilities: bool = False) -> DataFrame:
    """``keep`` columns with ``predicted`` (and ``probability``), each row by its prompt's model."""
    classes = coefficient_rows(rows.sparkSession, models, rows.schema[prompt])
    return score_rows(classes, rows, keep, prompt, probabilities)


def fit_coefficients(train: DataFrame, prompt: str = "prompt_name", **options) -> DataFrame:
    """Coefficients of every prompt's model: the prompt and ``classes``, as a staged table.

    Prompts are fitted in batches, whose coefficients are written, so neither the driver nor a plan
    holds all models.
    """
    spark = train.sparkSession
    path, schema = fresh_path(spark, "coefficients"), None
    train = by_prompt(train, prompt)
    for sizes in batched(prompt_sizes(train, prompt), PARALLEL_FITS):
        models = fit_prompts(train, prompt, sizes=sizes, **options)
        part = coefficient_rows(spark, models, train.schema[prompt])
        part.write.mode("append").parquet(path)
        schema = part.schema
    if schema is None:
        raise ValueError("no training rows")
    return spark.read.schema(schema).parquet(path)


def fit_and_predict(train: DataFrame, rows: DataFrame, keep: Sequence[str],
                    prompt: str = "prompt_name", probabilities: bool = False,
                    **options) -> DataFrame:
    """Predictions of every prompt's model for its ``rows``; null where a prompt has no model."""
    classes = fit_coefficients(train, prompt, **options)
    return score_rows(classes, rows, keep, prompt, probabilities)
