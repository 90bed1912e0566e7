"""Filling missing cells from neighbouring rows, from the text, or by a repeatable coin.

"Above" and "below" mean the nearest row with a known value in ``row_id`` order. ``row_id``
must be unique; it stands for the file order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.constants import COIN_FILLS
from gradeloom.functions.text import blank_word_count
from gradeloom.operators.ranking import number_rows
from gradeloom.sources.staging import settle, stage


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows without nulls in ``columns``, or in any column."""
    return df.na.drop("any", subset=list(columns) if columns else None)


def in_slices(df: DataFrame, order: str) -> DataFrame:
    """``df`` range-partitioned by ``order``, with the partition as ``_slice``; staged, so the
    slice bounds are the same for every reader."""
    return stage(
        df.repartitionByRange(order).withColumn("_slice", F.spark_partition_id()), "slices")


def nearest_known(sliced: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """``above_<c>`` and ``below_<c>``: nearest non-null values before and after each row.

    Windows run inside a slice; what a slice cannot see comes from the last and first known
    values of the other slices, a table with one row per slice.
    """
    known = []
    for c in columns:
        at = F.when(F.col(c).isNotNull(), F.col(order))
        known += [F.max_by(c, at).alias(f"_last_{c}"), F.min_by(c, at).alias(f"_first_{c}")]
    edges = sliced.groupBy("_slice").agg(*known)
    ahead = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    carried = edges.select(
        "_slice",
        *(F.last(f"_last_{c}", True).over(ahead).alias(f"_before_{c}") for c in columns),
        *(F.last(f"_first_{c}", True).over(behind).alias(f"_after_{c}") for c in columns))

    # Below is read in descending order: a frame that starts at the current row and runs to
    # the end is recomputed for every row.
    down = Window.partitionBy("_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    up = Window.partitionBy("_slice").orderBy(F.desc(order)).rowsBetween(
        Window.unboundedPreceding, -1)
    local = sliced.select(
        "*", *(F.last(c, True).over(down).alias(f"_above_{c}") for c in columns)
    ).select("*", *(F.last(c, True).over(up).alias(f"_below_{c}") for c in columns))
    return local.join(carried, "_slice", "left").select(
        *sliced.columns,
        *(F.coalesce(f"_above_{c}", f"_before_{c}").alias(f"above_{c}") for c in columns),
        *(F.coalesce(f"_below_{c}", f"_after_{c}").alias(f"below_{c}") for c in columns))


def same_above_below(column: str) -> Column:
    """Nearest known neighbours agree; false when one is missing."""
    return F.coalesce(F.col(f"above_{column}") == F.col(f"below_{column}"), F.lit(False))


def fill_assignment(placed: DataFrame) -> DataFrame:
    """Fill ``assignment``, and ``prompt_name`` where both are missing, from neighbours."""
    missing = F.col("assignment").isNull()
    no_prompt = F.col("prompt_name").isNull()
    agree = same_above_below("assignment")
    below_fits = F.coalesce(F.col("prompt_name") == F.col("below_prompt_name"), F.lit(False))
    return placed.withColumns({
        "assignment": F.when(~missing, F.col("assignment"))
        .when(~agree & ~no_prompt & below_fits, F.col("below_assignment"))
        .otherwise(F.col("above_assignment")),
        "prompt_name": F.when(missing & no_prompt & ~agree, F.col("above_prompt_name"))
        .otherwise(F.col("prompt_name")),
    })


def fill_prompt(placed: DataFrame) -> DataFrame:
    """Fill ``prompt_name`` where the neighbours agree; otherwise it stays null."""
    return placed.withColumn("prompt_name", F.coalesce(
        "prompt_name", F.when(same_above_below("prompt_name"), F.col("above_prompt_name"))))


def fill_forward(df: DataFrame, order: str, column: str) -> DataFrame:
    placed = nearest_known(in_slices(df, order), order, [column])
    return placed.withColumn(column, F.coalesce(column, f"above_{column}")).select(*df.columns)


def sorted_in_place(df: DataFrame, key: str, order: str) -> DataFrame:
    """Sort rows by ``key`` among themselves; rows with a null key keep their place.

    Returns ``df`` with a ``slot`` column, the order value of the place each row moves to.
    """
    filled = df.where(F.col(key).isNotNull()).select(order, key)
    places = number_rows(filled.select(F.col(order).alias("slot")), [], ["slot"])
    moved = number_rows(filled, [], [key, order]).join(places, "rank").select(order, "slot")
    return df.join(moved, order, "left").withColumn("slot", F.coalesce("slot", order))


def fill_word_count(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "essay_word_count", F.coalesce("essay_word_count", blank_word_count(F.col("full_text"))))


def hash_number(key: Column, salt: str) -> Column:
    """A repeatable 32-bit number per key and salt."""
    digest = F.md5(F.concat(key.cast("string"), F.lit("|"), F.lit(salt)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def fill_by_coin(df: DataFrame, key: str = "essay_id",
                 options: Mapping[str, tuple[str, str]] = COIN_FILLS) -> DataFrame:
    """Fill each column with one of two options by a hash of key and column name."""
    return df.withColumns({
        c: F.coalesce(c, F.when(hash_number(F.col(key), c) % 2 == 0, first).otherwise(second))
        for c, (first, second) in options.items()})


def fill_from_observed(df: DataFrame, column: str, key: str = "essay_id") -> DataFrame:
    """Fill with one of the column's own values, picked by hash from their sorted list."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    values = settle(number_rows(values, [], ["_value"], rank="_code"), "observed")
    size = values.count()
    if size == 0:
        return df
    pick = F.when(F.col(column).isNull(), hash_number(F.col(key), column) % size)
    return df.withColumn("_code", pick).join(values, "_code", "left").withColumn(
        column, F.coalesce(column, "_value")).select(*df.columns)


def fill_neighbours(df: DataFrame) -> DataFrame:
    """``row_id, assignment, prompt_name, grade_level`` after all neighbour rules."""
    narrow = df.select("row_id", "assignment", "prompt_name", "grade_level")
    sliced = in_slices(narrow, "row_id")
    first = nearest_known(sliced, "row_id", ["assignment", "prompt_name", "grade_level"])
    first = fill_assignment(first).withColumn(
        "grade_level", F.coalesce("grade_level", "above_grade_level")).select(*sliced.columns)
    # Same slices, so the second pass reuses the partitioning and order of the first.
    return fill_prompt(nearest_known(first, "row_id", ["prompt_name"])).select(*narrow.columns)


def fill_missing(df: DataFrame, sort_keys: Sequence[str] = ()) -> DataFrame:
    """Every fill rule in order, then drop rows that still hold a null.

    The ordered rules run on four narrow columns and are joined back by ``row_id``, so the texts
    go through no window, only through that join. With ``sort_keys`` rows are first sorted in place
    by each key in turn, and the neighbour rules see them in that order.
    """
    present = drop_missing(df, ["full_text"])
    narrow = present.select("row_id", "assignment", "prompt_name", "grade_level")
    if sort_keys:
        order = narrow.withColumn("_own", F.col("row_id"))
        for key in sort_keys:
            order = stage(sorted_in_place(order, key, "row_id").withColumn(
                "row_id", F.col("slot")).drop("slot"), "order")
        filled = stage(fill_neighbours(order.drop("_own")).join(
            order.select("row_id", "_own"), "row_id").withColumn("row_id", F.col("_own"))
            .drop("_own"), "filled")
    else:
        filled = stage(fill_neighbours(narrow), "filled")
    kept = fill_from_observed(fill_by_coin(fill_word_count(present)), "race_ethnicity")
    patched = kept.drop("assignment", "prompt_name", "grade_level").join(
        filled, "row_id", "left")
    return drop_missing(patched.select(*df.columns))
