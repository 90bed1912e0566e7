"""Global order without a global task.

A window over a whole group sends that group to one task, which fails once a group holds a
third of the data. Here rows are range-sorted over all tasks, every task numbers its own
rows, and only the per-task totals (groups + tasks rows) meet in a window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.sources.staging import settle, stage

_TASK, _SEQ = "_task", "_seq"
# Parts of a group that meet in the next round of a top-n cut.
PARTS_MERGED = 16


def _sorted_slices(df: DataFrame, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    # Staged so that every later read sees the same task numbers.
    ordered = df.orderBy(*by, *order)
    return stage(
        ordered.withColumn(_TASK, F.spark_partition_id())
        .withColumn(_SEQ, F.monotonically_increasing_id()), "sorted")


def _with_offsets(sliced: DataFrame, by: Sequence[str], size: Column) -> DataFrame:
    keys = [*by, _TASK]
    totals = sliced.groupBy(*keys).agg(size.alias("_size"), F.min(_SEQ).alias("_start"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy(_TASK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn(
        "_offset", F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    ).withColumn("_total", F.sum("_size").over(group)).drop("_size")
    offsets = settle(offsets, "offsets")
    null_safe = [sliced[k].eqNullSafe(offsets[k]) for k in by] + [sliced[_TASK] == offsets[_TASK]]
    condition = null_safe[0]
    for term in null_safe[1:]:
        condition = condition & term
    return sliced.join(offsets, condition, "left").select(sliced["*"], "_start", "_offset", "_total")


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[Column | str],
                rank: str = "rank", total: str | None = None) -> DataFrame:
    """0-based position of each row in its group by ``order``, and optionally the group size."""
    placed = _with_offsets(_sorted_slices(df, by, order), by, F.count(F.lit(1)))
    out = placed.withColumn(rank, F.col(_SEQ) - F.col("_start") + F.col("_offset"))
    if total:
        out = out.withColumn(total, F.col("_total"))
    return out.select(*df.columns, rank, *([total] if total else []))


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], weight: str,
                  before: str = "before", total: str = "total") -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the group, and over the whole group."""
    placed = _with_offsets(_sorted_slices(df, by, order), by, F.sum(weight))
    local = Window.partitionBy(*by, _TASK).orderBy(_SEQ).rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn(
        before, F.coalesce(F.sum(weight).over(local), F.lit(0)) + F.col("_offset")
    ).withColumn(total, F.col("_total")).select(*df.columns, before, total)


def ntile_of(rank: Column, total: Column, tiles: int) -> Column:
    """SQL ``ntile`` from a 0-based rank and the group size."""
    small = F.floor(total / F.lit(tiles))
    larger = total % F.lit(tiles)
    edge = larger * (small + 1)
    return F.when(rank < edge, F.floor(rank / (small + 1)) + 1).otherwise(
        larger + F.floor((rank - edge) / F.greatest(small, F.lit(1))) + 1).cast("bigint")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rank", spread_by: str | None = None,
                  salts: int | None = None) -> DataFrame:
    """First ``n`` rows of each group, ranked from 1.

    With ``spread_by`` a group is first cut down to n rows in each of some parts. There are as
    many parts as shuffle partitions (or ``salts``), a sixteenth of that in the next round and so
    on, so after the first round no task sees more than about 16 * n rows of a group.
    """
    if spread_by:
        parts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while parts > 1:
            salt = F.pmod(F.xxhash64(spread_by), F.lit(parts))
            part = Window.partitionBy(*by, "_salt").orderBy(*order)
            df = (df.withColumn("_salt", salt).withColumn("_part_rank", F.row_number().over(part))
                  .where(F.col("_part_rank") <= n).drop("_salt", "_part_rank"))
            parts //= PARTS_MERGED
    final = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(final)).where(F.col(rank) <= n)
