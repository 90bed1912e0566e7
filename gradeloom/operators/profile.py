"""Profiling: nulls, shape, counts, describe, histograms and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import or_

from pyspark.sql import DataFrame, functions as F, types as T

from gradeloom.operators.ranking import running_total


def rows_with_nulls(df: DataFrame) -> DataFrame:
    any_null = reduce(or_, (F.col(c).isNull() for c in df.columns))
    return df.agg(F.coalesce(F.sum(any_null.cast("bigint")), F.lit(0)).alias("rows_with_nulls"))


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "columns", F.lit(len(df.columns)).cast("bigint"))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def in_order_of_appearance(df: DataFrame, column: str, order: str) -> DataFrame:
    return df.groupBy(column).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def _cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    cells = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"))
        for c in columns))).alias("cell")
    return df.select(cells).select("cell.*").where(F.col("value").isNotNull())


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: ``column, share, value``.

    Values are counted, range-sorted over all tasks and located by running count; nothing
    holds a column's distinct values in one place.
    """
    counts = _cells(df, columns).groupBy("column", "value").agg(F.count(F.lit(1)).alias("rows"))
    placed = running_total(counts, ["column"], ["value"], "rows")
    last = F.col("before") + F.col("rows") - 1

    # A share falls between two neighbouring rows; keep the values that hold either of them.
    def holds(share):
        at = share * (F.col("total") - 1)
        return (F.col("before") <= F.ceil(at)) & (last >= F.floor(at))

    few = placed.where(reduce(or_, (holds(F.lit(s)) for s in shares)))
    hit = few.withColumn("share", F.explode(F.array(*(F.lit(s) for s in shares)))).where(
        holds(F.col("share")))
    at = F.col("share") * (F.col("total") - 1)
    low = F.floor(at)
    return hit.groupBy("column", "share").agg(
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
        F.max(at - low).alias("_part")).select(
        "column", "share",
        (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_part")).alias("value"))


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column`` with count, mean, sample deviation, minimum, exact quartiles and maximum."""
    columns = list(columns or numeric_columns(df))
    measures = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    wide = df.agg(*(f(F.col(c).cast("double")).alias(f"{name}_{i}")
                    for i, c in enumerate(columns) for name, f in measures.items()))
    basics = wide.select(F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), *(F.col(f"{name}_{i}").alias(name) for name in measures))
        for i, c in enumerate(columns)))).alias("cell")).select("cell.*")
    names = {0.25: "q25", 0.5: "q50", 0.75: "q75"}
    quartiles = quantiles(df, columns, list(names)).groupBy("column").agg(*(
        F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in names.items()))
    return basics.join(quartiles, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every ordered column pair, nulls dropped per pair; one pass."""
    columns = list(columns or numeric_columns(df))
    pairs = list(combinations(columns, 2))
    one = df.agg(*(F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}")
                   for i, (a, b) in enumerate(pairs)),
                 *(F.corr(F.col(a).cast("double"), F.col(a).cast("double")).alias(f"s{i}")
                   for i, a in enumerate(columns)))
    rows = [(a, b, f"c{i}") for i, (a, b) in enumerate(pairs)]
    rows += [(b, a, c) for a, b, c in rows] + [(a, a, f"s{i}") for i, a in enumerate(columns)]
    cells = F.explode(F.array(*(
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("correlation"))
        for a, b, c in rows))).alias("cell")
    return one.select(cells).select("cell.*")


def histogram(df: DataFrame, column: str, bins: int, low: float | None = None,
              high: float | None = None) -> DataFrame:
    """``bin, low_edge, rows`` over equal bins, empty ones included; the last bin is closed.

    Values outside ``low..high`` are dropped. Missing bounds are the column's own, fetched as
    one row; a column without values has bounds 0 and 1 and empty bins.
    """
    if low is None or high is None:
        seen = df.agg(F.min(column), F.max(column)).first()
        low, high = (0.0 if v is None else float(v) for v in seen)
        if seen[0] is None:
            high = 1.0
        elif low == high:
            low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    x = F.col(column).cast("double")
    slot = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(x.between(low, high)).groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("rows"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(
        counts, "bin", "left").select(
        "bin", (F.lit(low) + F.col("bin") * F.lit(width)).alias("low_edge"),
        F.coalesce("rows", F.lit(0)).alias("rows"))
