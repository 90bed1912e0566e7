"""The most frequent n-grams of each group without counting every n-gram.

``ngrams.gram_counts`` shuffles one row per distinct n-gram of a task, most of them seen once. Here
a sketch proposes candidates, their exact counts give a bound that the list cannot fall below,
and only n-grams that may reach the bound are counted one by one:

1. A mergeable heavy-hitters sketch per group proposes n candidates; what it says of their
   counts is not used.
2. One pass counts the candidates exactly, and everything else by hash cell. The smallest of n exact
   counts is a safe bound, and a cell's total is at least the count of each n-gram in it.
3. N-grams of cells that reach the bound are counted exactly; ties with the bound stay in.

The list equals that of exact counting, whatever the sketch proposes: poor candidates lower the
bound and let more n-grams through to step 3, and fewer than n candidates give no bound. The uses are read three times and shuffled as
sketches, candidates and cells: sizes that do not grow with the number of different n-grams.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.functions.constants import TOP_N
from gradeloom.functions.text import content_tokens, ngrams
from gradeloom.operators.ngrams import top_grams
from gradeloom.sources.staging import stage

CELLS = 1 << 16
# Items that a sketch follows for each one it is asked for.
TRACKED = 32
MOST_TRACKED = 1_000_000


def run_uses(runs: DataFrame) -> DataFrame:
    """``group_key, row_key, pos, gram, repeats`` from ``ngrams.doc_runs``: one row per document
    and n-gram, with its first place."""
    return runs.select("group_key", "row_key", F.explode("runs").alias("run")).select(
        "group_key", "row_key", F.col("run.first_pos").alias("pos"), "run.gram", "run.repeats")


def gram_uses(docs: DataFrame, group: str = "prompt_name", order: str = "row_id",
              text: str = "full_text", n: int = 2,
              tokenise: Callable[[Column], Column] = content_tokens) -> DataFrame:
    """``group_key, row_key, pos, gram``: one row per use, made where the text is read."""
    return docs.select(
        F.col(group).alias("group_key"), F.col(order).alias("row_key"),
        F.posexplode(ngrams(tokenise(F.col(text)), n)).alias("pos", "gram"))


def _same(left: DataFrame, right: DataFrame, *keys: str) -> Column:
    condition = left["group_key"].eqNullSafe(right["group_key"])
    for key in keys:
        condition = condition & (left[key] == right[key])
    return condition


def frequent_grams(uses: DataFrame, n: int = TOP_N, cells: int = CELLS) -> DataFrame:
    """The list of ``ngrams.top_grams`` from the rows of ``run_uses`` or ``gram_uses``.

    ``group_key, gram, occurrences, first_row, first_pos, rank``. Ties go to the n-gram seen first.
    Groups with fewer than n different n-grams list all of them; null groups are a group.
    """
    uses = uses.where(F.col("gram").isNotNull())
    if "repeats" not in uses.columns:
        uses = uses.groupBy("group_key", "row_key", "gram").agg(
            F.count(F.lit(1)).alias("repeats"), F.min("pos").alias("pos"))
    tracked = min(MOST_TRACKED, TRACKED * n)
    proposed = stage(
        uses.groupBy("group_key").agg(
            F.expr(f"approx_top_k(gram, {min(n, tracked)}, {tracked})").alias("found"))
        .select("group_key", F.explode("found.item").alias("gram"))
        .withColumn("proposed", F.lit(True)), "proposed")

    def marked(rows: DataFrame) -> DataFrame:
        return rows.join(proposed, _same(rows, proposed, "gram"), "left").select(
            *(rows[c] for c in rows.columns), proposed["proposed"],
            F.pmod(F.xxhash64(rows["gram"]), F.lit(cells)).alias("cell"))

    # Plain columns, so that rows are combined by hash and not sorted.
    summed = [F.sum("repeats").alias("occurrences"), F.min("row_key").alias("first_row"),
              F.min_by("pos", "row_key").alias("first_pos")]
    mine = F.col("proposed").isNotNull()
    counted = stage(
        marked(uses).groupBy(
            "group_key", F.when(mine, F.col("gram")).alias("gram"),
            F.when(~mine, F.col("cell")).alias("cell"))
        .agg(*summed), "counted")
    known = counted.where("gram IS NOT NULL").select(
        "group_key", "gram", "occurrences", "first_row", "first_pos")
    # At most n candidates of each group meet in this window.
    low = Window.partitionBy("group_key").orderBy(F.desc("occurrences"))
    bound = stage(known.withColumn("at", F.row_number().over(low)).where(F.col("at") == n).select(
        "group_key", F.col("occurrences").alias("bound")), "bound")
    rest = counted.where("cell IS NOT NULL").select("group_key", "cell", "occurrences")
    heavy = rest.join(bound, _same(rest, bound), "left").where(
        F.col("occurrences") >= F.coalesce("bound", F.lit(1))).select(rest["group_key"], "cell")
    heavy = stage(heavy, "cells")
    others = marked(uses).where("proposed IS NULL")
    survivors = others.join(heavy, _same(others, heavy, "cell"), "left_semi").groupBy(
        "group_key", "gram").agg(*summed)
    return top_grams(known.unionByName(survivors), n)
