"""Agreement and classification metrics, per group, from integer sums.

All inputs are frames of (group..., truth, predicted), or, with ``counted=True``, their confusion
table (group..., truth, predicted, rows). Each metric reads the rows once, to count them; everything after that works
on the confusion table (classes squared per group). Several metrics of one frame should share it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.constants import MAX_SCORE, MIN_SCORE


def checked(df: DataFrame, columns: Sequence[str], low: int = MIN_SCORE,
            high: int = MAX_SCORE) -> DataFrame:
    """Fail the job when a rating is missing or outside ``low..high``."""
    message = F.lit(f"All values must be between {low} and {high}")
    return df.withColumns({
        c: F.when(F.col(c).between(low, high), F.col(c)).otherwise(F.raise_error(message))
        for c in columns})


def confusion(df: DataFrame, by: Sequence[str], truth: str = "score",
              predicted: str = "predicted", counted: bool = False) -> DataFrame:
    """Sparse confusion table: group, truth, predicted, rows; ``df`` itself if it is one."""
    if counted:
        return df.select(*by, truth, predicted, "rows")
    return df.groupBy(*by, truth, predicted).agg(F.count(F.lit(1)).alias("rows"))


def dense_confusion(df: DataFrame, by: Sequence[str], truth: str, predicted: str,
                    low: int = MIN_SCORE, high: int = MAX_SCORE,
                    counted: bool = False) -> DataFrame:
    """Confusion table with every label pair, marginals and expected count."""
    labels = F.sequence(F.lit(low), F.lit(high))
    counts = confusion(df, by, truth, predicted, counted)
    grid = counts.select(*by).distinct().withColumn(truth, F.explode(labels)).withColumn(
        predicted, F.explode(labels))
    full = grid.join(counts, [*by, truth, predicted], "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0)))
    # Windows over classes squared rows per group.
    total = F.sum("rows").over(Window.partitionBy(*by))
    return full.withColumns({
        "truth_rows": F.sum("rows").over(Window.partitionBy(*by, truth)),
        "predicted_rows": F.sum("rows").over(Window.partitionBy(*by, predicted)),
    }).withColumn("expected", F.try_divide(
        (F.col("truth_rows") * F.col("predicted_rows")).cast("double"), total))


def _wide(column: Column) -> Column:
    # Products of sums over 10^10 rows leave 64 bits.
    return F.sum(column).cast("decimal(19,0)")


def _moments(df: DataFrame, by: Sequence[str], t: Column, p: Column) -> DataFrame:
    n = F.col("rows")
    return df.groupBy(*by).agg(
        _wide(n).alias("n"), _wide(t * n).alias("st"), _wide(p * n).alias("sp"),
        _wide(t * t * n).alias("stt"), _wide(p * p * n).alias("spp"),
        _wide((t - p) * (t - p) * n).alias("diff"))


def quadratic_weighted_kappa(df: DataFrame, by: Sequence[str], truth: str = "score",
                             predicted: str = "predicted", counted: bool = False) -> DataFrame:
    """1 - observed / expected squared disagreement, per group.

    The expected term sums (t-p)^2 over all pairs of marginals, which expands into sums and
    sums of squares, so one pass of six integers replaces the matrices.
    """
    t, p = (F.col(c).cast("bigint") for c in (truth, predicted))
    pairs = confusion(df, by, truth, predicted, counted)
    m = _moments(checked(pairs, [truth, predicted]), by, t, p)
    n, diff = F.col("n"), F.col("diff")
    expected = n * F.col("stt") - F.col("st") * F.col("sp") * 2 + n * F.col("spp")
    kappa = F.lit(1.0) - (n * diff).cast("double") / expected.cast("double")
    return m.select(*by, F.when(expected == 0, F.when(diff == 0, 1.0).otherwise(0.0))
                    .otherwise(kappa).alias("kappa"))


def shifted_kappa(df: DataFrame, by: Sequence[str], classes: int = MAX_SCORE,
                  truth: str = "score", predicted: str = "predicted",
                  counted: bool = False) -> DataFrame:
    """The other kappa: ratings 1..classes-1 only, expected term from the truth marginal."""
    t, p = (F.col(c).cast("bigint") for c in (truth, predicted))
    top = classes - 1
    inside = t.between(1, top) & p.between(1, top)
    # Pairs outside the range count as zero rows, which keeps groups that have no others.
    pairs = confusion(df, by, truth, predicted, counted)
    used = _moments(pairs.withColumn("rows", F.when(inside, F.col("rows")).otherwise(0)), by, t, p)
    n = F.col("n").cast("double")
    observed = F.col("diff").cast("double")
    expected = (F.col("n") * F.col("stt") - F.col("st") * F.col("sp") * 2
                + F.col("n") * F.col("spp")).cast("double")
    expected = F.try_divide(expected, n)
    own = ((F.col("n") * F.col("stt") - F.col("st") * F.col("st")) * 2).cast("double")
    own = F.try_divide(own, n)
    denominator = own - expected
    flat = F.when(observed == expected, 1.0).otherwise(0.0)
    value = F.when(F.col("n").isNull(), F.raise_error(F.lit("no ratings"))).when(
        F.col("n") == 0, 0.0).when(F.abs(denominator) < 1e-10, flat).otherwise(
        F.lit(1.0) - (observed - expected) / denominator)
    return used.select(*by, value.alias("kappa"))


def accuracy(df: DataFrame, by: Sequence[str], truth: str = "score",
             predicted: str = "predicted", counted: bool = False) -> DataFrame:
    right = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("rows")).otherwise(0))
    return confusion(df, by, truth, predicted, counted).groupBy(*by).agg(
        (right.cast("double") / F.sum("rows")).alias("accuracy"))


def weighted_accuracy(df: DataFrame, by: Sequence[str], weights: DataFrame | None = None,
                      truth: str = "score", predicted: str = "predicted",
                      counted: bool = False) -> DataFrame:
    """Share of weight on rows predicted right; ``weights`` has group, truth and ``weight``.

    The join sees classes only.
    """
    if weights is None:
        return accuracy(df, by, truth, predicted, counted).withColumnRenamed("accuracy", "weighted_accuracy")
    right = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("rows")).otherwise(0))
    classes = confusion(df, by, truth, predicted, counted).groupBy(*by, truth).agg(
        right.alias("right"), F.sum("rows").alias("rows"))
    known = classes.join(weights.select(*by, truth, "weight"), [*by, truth], "left").withColumn(
        "weight", F.when(F.col("weight").isNotNull(), F.col("weight")).otherwise(
            F.raise_error(F.lit("no weight for a label"))))
    share = F.sum(F.col("right") * F.col("weight")) / F.sum(F.col("rows") * F.col("weight"))
    return known.groupBy(*by).agg(share.alias("weighted_accuracy"))


def class_report(df: DataFrame, by: Sequence[str], truth: str = "score",
                 predicted: str = "predicted", counted: bool = False) -> DataFrame:
    """Precision, recall, F1 and support per class that occurs as truth or prediction."""
    t, p = F.col(truth), F.col(predicted)
    cells = confusion(df, by, truth, predicted, counted).select(*by, F.explode(F.array(
        F.struct(t.alias("label"), F.col("rows").alias("support"), F.lit(0).cast("bigint")
                 .alias("called"), F.when(t == p, F.col("rows")).otherwise(0).alias("right")),
        F.struct(p.alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("rows").alias("called"), F.lit(0).cast("bigint").alias("right")),
    )).alias("cell")).select(*by, "cell.*")
    sums = cells.groupBy(*by, "label").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"),
        F.sum("right").alias("right"))
    right = F.col("right").cast("double")
    return sums.select(
        *by, "label", "support",
        F.coalesce(F.try_divide(right, F.col("called")), F.lit(0.0)).alias("precision"),
        F.coalesce(F.try_divide(right, F.col("support")), F.lit(0.0)).alias("recall"),
        F.coalesce(F.try_divide(right * 2, F.col("called") + F.col("support")), F.lit(0.0))
        .alias("f1_score"))


def evaluate(df: DataFrame, by: Sequence[str], truth: str = "score",
             predicted: str = "predicted", counted: bool = False) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1 per group."""
    report = class_report(df, by, truth, predicted, counted)
    n = F.sum("support")
    share = {m: (F.sum(F.col(m) * F.col("support")) / n).alias(m)
             for m in ("precision", "recall", "f1_score")}
    # Recall times support is the number of hits, so weighted recall is the accuracy.
    return report.groupBy(*by).agg(*share.values()).select(
        *by, F.col("recall").alias("accuracy"), "precision", "recall", "f1_score")


def grade_distribution(df: DataFrame, by: Sequence[str], truth: str = "score",
                       predicted: str = "predicted", counted: bool = False) -> DataFrame:
    """Rows per grade, predicted against actual; a side without the grade is null.

    Both value counts come out of one aggregation, not a join of two.
    """
    n, none = F.col("rows"), F.lit(0).cast("bigint")
    sides = confusion(df, by, truth, predicted, counted).select(*by, F.explode(F.array(
        F.struct(F.col(predicted).cast("bigint").alias("grade"), n.alias("p"), none.alias("a")),
        F.struct(F.col(truth).cast("bigint").alias("grade"), none.alias("p"), n.alias("a")),
    )).alias("side")).select(*by, "side.*")
    sums = sides.groupBy(*by, "grade").agg(F.sum("p").alias("p"), F.sum("a").alias("a"))
    return sums.select(*by, "grade", F.nullif("p", F.lit(0)).alias("predicted"),
                       F.nullif("a", F.lit(0)).alias("actual"))


def long_metrics(metrics: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per metric from one column per metric."""
    names = [c for c in metrics.columns if c not in by]
    pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                      for c in names))
    return metrics.select(*by, F.explode(pairs).alias("m")).select(*by, "m.metric", "m.value")
