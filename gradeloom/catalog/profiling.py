"""Profiling of the essay view and the larger tables."""

from __future__ import annotations


from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.functions.constants import ENCODED
from gradeloom.operators import profile as pf
from gradeloom.plans.runs import encoded_essays, filled_essays
from gradeloom.sources.essays import essay_view, scored_documents
from gradeloom.sources.tables import spread, table

ANY_NULL = " OR ".join(f"{c} IS NULL" for c in sql.ESSAY_COLUMNS)
LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("rows_with_nulls", "A1", sql.ESSAY + f"""
SELECT count(*) FILTER (WHERE {ANY_NULL}) AS rows_with_nulls FROM essays""")
def rows_with_nulls(spark, folder):
    return pf.rows_with_nulls(essay_view(spark, folder))


@query("rows_with_nulls_after_fill", "A1 I1", sql.with_(sql.FILLED) + f"""
SELECT count(*) FILTER (WHERE {ANY_NULL}) AS rows_with_nulls FROM filled""")
def rows_with_nulls_after_fill(spark, folder):
    return pf.rows_with_nulls(filled_essays(essay_view(spark, folder)))


@query("frame_shape", "P10", """
SELECT count(*) AS rows, 11::BIGINT AS columns FROM lineitem""")
def frame_shape(spark, folder):
    return pf.shape(table(spark, folder, "lineitem"))


@query("distinct_prompts", "A2", """
SELECT source, min(doc_id) AS first_seen FROM documents GROUP BY source""")
def distinct_prompts(spark, folder):
    return pf.in_order_of_appearance(table(spark, folder, "documents"), "source", "doc_id")


@query("score_counts", "A3", sql.with_(sql.SCORED) + """
SELECT score, count(*) AS rows FROM scored GROUP BY score ORDER BY score""")
def score_counts(spark, folder):
    return pf.value_counts(scored_documents(spark, folder), "score").orderBy("score")


@query("return_flag_counts", "A3", """
SELECT l_returnflag, count(*) AS rows FROM lineitem GROUP BY l_returnflag""")
def return_flag_counts(spark, folder):
    return pf.value_counts(table(spark, folder, "lineitem"), "l_returnflag")


@query("sorted_prompts", "K1", "SELECT DISTINCT lang AS prompt_name FROM documents ORDER BY 1")
def sorted_prompts(spark, folder):
    return table(spark, folder, "documents").select(
        F.col("lang").alias("prompt_name")).distinct().orderBy("prompt_name")


@query("sorted_essays", "K2", sql.ESSAY + """
SELECT essay_id, assignment FROM essays WHERE assignment IS NOT NULL ORDER BY assignment, essay_id""")
def sorted_essays(spark, folder):
    return essay_view(spark, folder).where(F.col("assignment").isNotNull()).select(
        "essay_id", "assignment").orderBy("assignment", "essay_id")


@query("mean_scores", "A7", sql.with_(sql.SCORED) + """
SELECT lang, sum(score)::DOUBLE / count(*) AS mean_score FROM scored GROUP BY lang""")
def mean_scores(spark, folder):
    return scored_documents(spark, folder).groupBy("lang").agg(
        (F.sum("score").cast("double") / F.count(F.lit(1))).alias("mean_score"))


def sql_describe(source: str, columns) -> str:
    return " UNION ALL ".join(f"""
SELECT '{c}' AS "column", count({c}) AS "count", round(avg({c}), 7) AS mean,
  round(stddev_samp({c}), 7) AS std, min({c})::DOUBLE AS min,
  round(quantile_cont({c}::DOUBLE, 0.25), 7) AS q25,
  round(quantile_cont({c}::DOUBLE, 0.5), 7) AS q50,
  round(quantile_cont({c}::DOUBLE, 0.75), 7) AS q75, max({c})::DOUBLE AS max
FROM {source}""" for c in columns)


def described(df, columns):
    out = pf.describe(df, columns)
    return out.withColumns(
        {c: F.round(c, 7) for c in ("mean", "std", "q25", "q50", "q75")})


@query("describe_essays", "A8", sql.ESSAY + sql_describe(
    "essays", ["score", "essay_word_count", "grade_level"]))
def describe_essays(spark, folder):
    return described(essay_view(spark, folder), ["score", "essay_word_count", "grade_level"])


@query("describe_lineitem", "A8", sql_describe("lineitem", LINE_NUMBERS))
def describe_lineitem(spark, folder):
    return described(spread(table(spark, folder, "lineitem")), LINE_NUMBERS)


def sql_correlations(source: str, columns) -> str:
    pairs = [(a, b) for a in columns for b in columns]
    return " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM {source}"
        for a, b in pairs)


def rounded_correlations(df, columns):
    return pf.correlations(df, columns).withColumn("correlation", F.round("correlation", 6))


CODED = ["score", "essay_word_count", "grade_level", *ENCODED]


@query("essay_correlations", "A9", sql.with_(
    sql.FILLED, "coded AS (SELECT score, essay_word_count, grade_level, " + ", ".join(
        f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in ENCODED) + " FROM filled)")
    + sql_correlations("coded", CODED))
def essay_correlations(spark, folder):
    return rounded_correlations(
        encoded_essays(filled_essays(essay_view(spark, folder))), CODED)


@query("lineitem_correlations", "A9", sql_correlations("lineitem", LINE_NUMBERS))
def lineitem_correlations(spark, folder):
    return rounded_correlations(spread(table(spark, folder, "lineitem")), LINE_NUMBERS)


@query("word_count_histogram", "A10", sql.ESSAY + """
SELECT b.bin, b.bin * 30.0::DOUBLE AS low_edge, count(e.n) AS rows
FROM (SELECT unnest(range(0, 50)) AS bin) b LEFT JOIN (
  SELECT least(floor(essay_word_count / 30.0::DOUBLE), 49)::BIGINT AS bin, 1 AS n FROM essays
  WHERE essay_word_count BETWEEN 0 AND 1500) e ON e.bin = b.bin
GROUP BY b.bin""")
def word_count_histogram(spark, folder):
    return pf.histogram(essay_view(spark, folder), "essay_word_count", 50, 0.0, 1500.0)


@query("score_histogram", "A11", sql.with_(sql.SCORED) + """
, bounds AS (SELECT min(score)::DOUBLE AS lo, max(score)::DOUBLE AS hi FROM scored)
SELECT b.bin, any_value(lo + b.bin * ((hi - lo) / 5)) AS low_edge, count(e.score) AS rows
FROM (SELECT unnest(range(0, 5)) AS bin) b CROSS JOIN bounds LEFT JOIN scored e
  ON b.bin = least(floor((e.score - lo) / ((hi - lo) / 5)), 4)
GROUP BY b.bin""")
def score_histogram(spark, folder):
    return pf.histogram(scored_documents(spark, folder), "score", 5)


@query("price_histogram", "A11", """
WITH bounds AS (SELECT min(o_totalprice)::DOUBLE AS lo, max(o_totalprice)::DOUBLE AS hi FROM orders)
SELECT b.bin, any_value(lo + b.bin * ((hi - lo) / 50)) AS low_edge, count(e.o_totalprice) AS rows
FROM (SELECT unnest(range(0, 50)) AS bin) b CROSS JOIN bounds LEFT JOIN orders e
  ON b.bin = least(floor((e.o_totalprice - lo) / ((hi - lo) / 50)), 49)
GROUP BY b.bin""")
def price_histogram(spark, folder):
    return pf.histogram(table(spark, folder, "orders"), "o_totalprice", 50)


