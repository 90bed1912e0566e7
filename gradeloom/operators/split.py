"""Stratified split, class weights and under-sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.constants import SPLIT_SEED
from gradeloom.sources.staging import stage


def mark_by_quota(df: DataFrame, key: str, groups: Sequence[str], quota_of, seed: int,
                  mark: str) -> DataFrame:
    """Boolean ``mark`` on the first ``quota`` rows of each group in hash order of ``key``.

    ``quota_of`` maps a frame of groups with their ``size`` to one with a ``quota`` column.
    Group sizes are counted per hash cell (4096 per group); only the one cell in which the quota
    ends is ranked, 1/4096 of the group. That gives one cut-off per group, and the rows are marked
    in one pass by comparing with it.
    """
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit("|"), F.lit(str(seed))))
    keyed = df.withColumn("_hash", digest).withColumn(
        "_cell", F.conv(F.substring("_hash", 1, 3), 16, 10).cast("int"))
    cells = stage(keyed.groupBy(*groups, "_cell").agg(F.count(F.lit(1)).alias("rows")), "cells")
    quotas = quota_of(cells.groupBy(*groups).agg(F.sum("rows").alias("size")))
    before = Window.partitionBy(*groups).orderBy("_cell").rowsBetween(
        Window.unboundedPreceding, -1)
    counted = cells.withColumn("_before", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    edges = counted.join(quotas, [*groups]).where(
        (F.col("_before") < F.col("quota")) & (F.col("quota") <= F.col("_before") + F.col("rows")))
    edges = edges.select(*groups, F.col("_cell").alias("_edge"),
                         (F.col("quota") - F.col("_before")).alias("_take"))
    # Inside the edge cell the last row that is taken gives one cut-off per group.
    inside = Window.partitionBy(*groups).orderBy("_hash", key)
    last = keyed.join(edges, [*groups]).where(F.col("_cell") == F.col("_edge")).withColumn(
        "_rank", F.row_number().over(inside)).where(F.col("_rank") == F.col("_take")).select(
        *groups, "_edge", F.col("_hash").alias("_last_hash"), F.col(key).alias("_last_key"))
    last = stage(last, "cuts")
    at = F.struct(F.col("_hash"), F.col(key)) <= F.struct(F.col("_last_hash"), F.col("_last_key"))
    taken = (F.col("_cell") < F.col("_edge")) | ((F.col("_cell") == F.col("_edge")) & at)
    return keyed.join(last, [*groups], "left").withColumn(
        mark, F.coalesce(taken, F.lit(False))).select(*df.columns, mark)


def split_quotas(sizes: DataFrame, prompt: str, label: str, test_size: float) -> DataFrame:
    """Test rows per stratum: proportional, left-over rows to the largest remainders."""
    group = Window.partitionBy(prompt)
    n, total = F.col("size"), F.sum("size").over(group)
    wanted = F.ceil(F.lit(float(test_size)) * F.col("_total"))
    sized = sizes.withColumn("_total", total).withColumn("_test", wanted)
    shared = sized.withColumn(
        "_base", F.expr("_test * size div _total")
    ).withColumn("_left", (F.col("_test") * n) % F.col("_total"))
    order = Window.partitionBy(prompt).orderBy(F.desc("_left"), F.asc(label))
    spare = F.col("_test") - F.sum("_base").over(group)
    return shared.withColumn("_spare", spare).withColumn(
        "_rank", F.row_number().over(order)
    ).withColumn(
        "quota", F.col("_base") + F.when(F.col("_rank") <= F.col("_spare"), 1).otherwise(0)
    ).select(prompt, label, "quota")


def stratified_split(df: DataFrame, key: str = "essay_id", prompt: str = "prompt_name",
                     label: str = "score", test_size: float = 0.2,
                     seed: int = SPLIT_SEED) -> DataFrame:
    """``df`` with ``is_test``, stratified by label inside each prompt."""
    return mark_by_quota(
        df, key, [prompt, label], lambda sizes: split_quotas(sizes, prompt, label, test_size),
        seed, "is_test")


def under_sample(df: DataFrame, key: str, prompt: str, label: str,
                 seed: int = SPLIT_SEED) -> DataFrame:
    """Cut every class of a prompt to the size of its smallest class."""
    smallest = F.min("size").over(Window.partitionBy(prompt))
    marked = mark_by_quota(
        df, key, [prompt, label],
        lambda sizes: sizes.select(prompt, label, smallest.alias("quota")), seed, "_kept")
    return marked.where("_kept").drop("_kept")


def class_weights(train: DataFrame, prompt: str = "prompt_name", label: str = "score",
                  scheme: str = "exponential") -> DataFrame:
    """``prompt, label, rows, weight`` from training rows; one row per class."""
    group = Window.partitionBy(prompt)
    counts = train.groupBy(prompt, label).agg(F.count(F.lit(1)).alias("rows"))
    rows, total = F.col("rows").cast("double"), F.sum("rows").over(group).cast("double")
    weight: dict[str, Column] = {
        "exponential": F.exp(-rows / total),
        "balanced": total / (F.count(F.lit(1)).over(group) * rows),
        "root": F.sqrt(total / rows),
    }
    return counts.withColumn("weight", weight[scheme])
