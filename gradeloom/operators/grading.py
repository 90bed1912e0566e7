"""Bell-curve grades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.functions.constants import BELL_BOUNDS
from gradeloom.sources.staging import settle


def z_scores(df: DataFrame, by: Sequence[str], score: str, alambda: float = 1.0,
             spread: str = "mean") -> DataFrame:
    """``z``: distance from the group mean in units of ``spread * alambda``.

    The unit is the mean itself by default; ``spread='std'`` takes the population deviation.
    Group statistics are aggregated and joined back, so a large group stays spread out. A
    zero unit gives null.
    """
    unit = F.avg(score) if spread == "mean" else F.stddev_pop(score)
    stats = settle(df.groupBy(*by).agg(F.avg(score).alias("_mean"), unit.alias("_unit")), "stats")
    return df.join(stats, [*by], "left").withColumn("z", F.try_divide(
        F.col(score) - F.col("_mean"), F.col("_unit") * F.lit(float(alambda)))
    ).drop("_mean", "_unit")


def bell_grade(z: Column) -> Column:
    grade = F.when(z.isNull(), F.lit(None))
    for bound, value in BELL_BOUNDS:
        grade = grade.when(z >= bound, F.lit(value))
    return grade.otherwise(F.lit(1)).cast("bigint")


def bell_curve_grades(df: DataFrame, by: Sequence[str], score: str, alambda: float = 1.0,
                      spread: str = "mean") -> DataFrame:
    return z_scores(df, by, score, alambda, spread).withColumn("grade", bell_grade(F.col("z")))
