"""Category codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.constants import ENCODED
from gradeloom.operators.ranking import number_rows
from gradeloom.sources.staging import settle


def label_codes(df: DataFrame, columns: Sequence[str] = ENCODED) -> DataFrame:
    """``column, code, label``: codes 0..k-1 in sorted label order, from one scan."""
    cells = F.explode(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("label"))
        for c in columns))).alias("cell")
    labels = df.select(cells).select("cell.*").where(F.col("label").isNotNull()).distinct()
    return settle(
        number_rows(labels, ["column"], ["label"], rank="code").select("column", "code", "label"),
        "codes")


def encode(df: DataFrame, codes: DataFrame, columns: Sequence[str] = ENCODED) -> DataFrame:
    """Replace labels by their codes."""
    out = df
    for c in columns:
        lookup = codes.where(F.col("column") == c).select(
            F.col("label").alias(c), F.col("code").alias(f"_{c}"))
        out = out.join(lookup, c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return out.select(*df.columns)
