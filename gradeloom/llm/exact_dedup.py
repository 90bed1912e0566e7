"""Exact duplicates by most-significant-first radix partitioning.

Documents are split by their first block of bytes, groups of several documents by the next
block, and so on until a group has one member or its texts have ended. Equality is decided by
the bytes themselves. Blocks double in width without a ceiling, so a text of n bytes takes about
log2(n / 256) rounds, and only members of groups that are still shared go to the next round. The
widest block is half of the text that it was cut from, which its row holds anyway.

A round is one aggregate with map-side combine (a group of copies leaves one row per task) and
one join of rows to the group table. The group table has one row per group, so a hot group is
split by adaptive skew handling on the row side.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gradeloom.llm.common import Scratch, release_shuffles

FIRST_BLOCK = 256
# No text is longer than a Spark value, so this only keeps widths within an int.
WIDEST_BLOCK = 1 << 30
SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def exact_duplicates(docs: DataFrame, first: int = FIRST_BLOCK,
                     widest: int = WIDEST_BLOCK) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are after every run of ASCII white space became one space;
    null counts as empty. The smallest doc_id of a group stays. A null doc_id never wins over a
    known one; if a group has only null ids, keep_id is null and one of its rows stays. Of rows
    that repeat both id and text one stays. Other columns of ``docs`` are ignored. An empty
    table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rest = normalised(F.col("text"))
    rows = docs.select("doc_id", F.sha2(rest.cast("binary"), 256).alias("sha"),
                       F.lit(0).cast("bigint").alias("grp"), rest.cast("binary").alias("rest"))
    done, width, held = [], first, []
    while True:
        block = F.substring(F.col("rest"), 1, width)
        ended = F.octet_length("rest") <= width
        split = rows.select("doc_id", "sha", "grp", block.alias("block"), ended.alias("ended"),
                            F.substring(F.col("rest"), width + 1, 2**31 - 1).alias("rest"))
        sizes = split.groupBy("grp", "block", "ended").agg(
            F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keep_id"),
            F.min("sha").alias("sha"))
        # Groups of one are finished: their aggregate row is their result row.
        sizes = scratch.write(sizes.withColumn(
            "block", F.when(F.col("n") > 1, F.col("block"))), "sizes")
        done.append(sizes.where("n = 1").select(
            F.col("keep_id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), "sha"))
        shared = scratch.write(sizes.where("n > 1").select(
            "grp", "block", "ended", "n", "keep_id",
            F.monotonically_increasing_id().alias("next_grp")), "shared")
        members = scratch.write(split.join(shared, ["grp", "block", "ended"]).select(
            "doc_id", "sha", "keep_id", F.col("n").alias("group_size"),
            F.col("next_grp").alias("grp"), "ended",
            F.when(~F.col("ended"), F.col("rest")).alias("rest")), "members")
        done.append(members.where("ended").select("doc_id", "keep_id", "group_size", "sha"))
        for old in held:
            scratch.drop(old)
        rows = members.where("not ended").select("doc_id", "sha", "grp", "rest")
        if rows.isEmpty():
            break
        done[-1] = scratch.write(done[-1], "ended")
        held = [members, shared]
        width = min(2 * width, widest)
    # Repeats of one id and text come as one counted row, so the first of them can stay alone.
    counted = reduce(DataFrame.union, done).groupBy("doc_id", "keep_id", "group_size", "sha").agg(
        F.count(F.lit(1)).alias("n"))
    return counted.select(
        "*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("nth")
    ).select("doc_id", "keep_id", "group_size",
             (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
             F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns they came with."""
    kept = exact_duplicates(docs).where("kept").select(
        F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha"))
    kept = Scratch(docs.sparkSession, "kept").write(kept, "ids")
    # The texts are shuffled once more: first let go of the rounds' shuffles, which are done with.
    release_shuffles(docs.sparkSession)
    marked = docs.select(F.struct("*").alias("_doc"), F.col("doc_id").alias("_id"), F.sha2(
        normalised(F.col("text")).cast("binary"), 256).alias("_sha"))
    same = marked["_id"].eqNullSafe(kept["_kept_id"]) & (marked["_sha"] == kept["_kept_sha"])
    return (marked.join(kept, same, "left_semi").dropDuplicates(["_id", "_sha"])
            .select("_doc.*"))
