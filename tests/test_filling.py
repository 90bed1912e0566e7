import pytest
from pyspark.sql import functions as F

from gradeloom.operators import impute as im
from gradeloom.operators.encode import encode, label_codes
from gradeloom.operators.ranking import number_rows, ntile_of, running_total, top_per_group
from gradeloom.operators.split import class_weights, stratified_split, under_sample
from gradeloom.sources import essays as es

NARROW = "row_id bigint, assignment string, prompt_name string, grade_level bigint"


def filled(spark, rows):
    df = spark.createDataFrame(rows, NARROW)
    got = im.fill_neighbours(df).orderBy("row_id").collect()
    return [(r.assignment, r.prompt_name, r.grade_level) for r in got]


def test_neighbours_agree(spark):
    got = filled(spark, [(1, "a1", "a", 6), (2, None, None, None), (3, "a1", "a", 8)])
    assert got[1] == ("a1", "a", 6)


def test_prompt_decides_when_neighbours_differ(spark):
    got = filled(spark, [(1, "a1", "a", 6), (2, None, "b", 6), (3, "b1", "b", 6)])
    assert got[1] == ("b1", "b", 6)
    got = filled(spark, [(1, "a1", "a", 6), (2, None, "a", 6), (3, "b1", "b", 6)])
    assert got[1] == ("a1", "a", 6)


def test_both_missing_copies_the_row_above(spark):
    got = filled(spark, [(1, "a1", "a", 6), (2, None, None, 6), (3, "b1", "b", 6)])
    assert got[1] == ("a1", "a", 6)


def test_prompt_stays_null_between_different_prompts(spark):
    got = filled(spark, [(1, "a1", "a", 6), (2, "x1", None, 6), (3, "b1", "b", 6)])
    assert got[1] == ("x1", None, 6)


def test_filled_prompt_counts_as_a_neighbour(spark, many_tasks):
    # Row 3 takes prompt a from above; row 2 then has a on both sides.
    got = filled(spark, [
        (1, "a1", "a", 6), (2, "a1", None, 6), (3, None, None, 6), (4, "b1", "b", 6)])
    assert got[1] == ("a1", "a", 6) and got[2] == ("a1", "a", 6)


def test_edges_and_runs(spark, many_tasks):
    got = filled(spark, [(1, None, None, None), (2, "a1", "a", 7), (3, None, None, None),
                         (4, None, None, None), (5, None, None, None)])
    assert got[0] == (None, None, None)
    assert got[2:] == [("a1", "a", 7)] * 3


def test_neighbours_across_slices(spark, many_tasks):
    # Known values are rare, so most slices hold none and must be carried over.
    rows = [(i, f"v{i}" if i % 97 == 0 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "row_id bigint, v string").repartition(7)
    sliced = im.in_slices(df, "row_id")
    assert sliced.select("_slice").distinct().count() > 1
    got = {r.row_id: (r.above_v, r.below_v)
           for r in im.nearest_known(sliced, "row_id", ["v"]).collect()}
    for i, _ in rows:
        above = (i - 1) // 97 * 97 if i else None
        below = (i // 97 + 1) * 97
        assert got[i] == (
            None if above is None else f"v{above}", f"v{below}" if below < 2000 else None)


def test_sorted_in_place(spark, many_tasks):
    df = spark.createDataFrame(
        [(1, 9), (2, None), (3, 7), (4, 8)], "row_id bigint, grade_level bigint")
    got = {r.row_id: r.slot for r in im.sorted_in_place(df, "grade_level", "row_id").collect()}
    assert got == {3: 1, 2: 2, 4: 3, 1: 4}


def test_fill_missing_leaves_no_null(spark, folder):
    essays = es.essay_view(spark, folder)
    got = im.fill_missing(essays)
    assert got.columns == essays.columns
    assert got.count() > 0 and im.drop_missing(got).count() == got.count()


def test_all_missing_category_is_left_alone(spark):
    df = spark.createDataFrame([(1, None)], "essay_id bigint, race_ethnicity string")
    assert im.fill_from_observed(df, "race_ethnicity").first().race_ethnicity is None


def test_csv_keeps_line_breaks_quotes_and_nulls(spark, tmp_path):
    row = (1, 1, 3, 'He said "no",\n  then\tleft ', None, "a1", None, 6, "x", "y", "z", "r", "M")
    df = spark.createDataFrame([row], es.ESSAY_SCHEMA)
    es.write_essays_csv(df, str(tmp_path / "csv"))
    assert tuple(es.read_essays_csv(spark, str(tmp_path / "csv")).first()) == row


def test_codes_are_dense_and_sorted(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", None)], "c string, d string")
    codes = label_codes(df, ["c", "d"])
    assert sorted(map(tuple, codes.collect())) == [("c", 0, "a"), ("c", 1, "b"), ("d", 0, "x")]
    got = sorted(map(tuple, encode(df, codes, ["c", "d"]).collect()), key=str)
    assert got == [(0, 0), (1, 0), (1, None)]


def test_row_numbers_over_tasks(spark, many_tasks):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), F.col("id"),
        (F.col("id") * 7919 % 5000).alias("k")).repartition(5)
    got = number_rows(df, ["g"], ["k"], total="n").collect()
    for g in ("hot", "cold"):
        part = sorted((r for r in got if r.g == g), key=lambda r: r.k)
        assert [r["rank"] for r in part] == list(range(len(part)))
        assert {r.n for r in part} == {len(part)}


def test_row_numbers_keep_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), ("a", 3)], "g string, k bigint")
    got = {(r.g, r.k): r["rank"] for r in number_rows(df, ["g"], ["k"]).collect()}
    assert got == {(None, 1): 0, (None, 2): 1, ("a", 3): 0}


def test_running_total(spark, many_tasks):
    df = spark.range(1000).select(
        (F.col("id") % 2).alias("g"), F.col("id").alias("k"), (F.col("id") % 5).alias("w"))
    got = running_total(df, ["g"], ["k"], "w").collect()
    for g in (0, 1):
        seen = 0
        for r in sorted((r for r in got if r.g == g), key=lambda r: r.k):
            assert r.before == seen
            seen += r.w
        assert {r.total for r in got if r.g == g} == {seen}


@pytest.mark.parametrize("size", [1, 4, 6, 13, 100])
def test_ntile(spark, size):
    df = spark.range(size).selectExpr("id as r", f"{size}L as n", "ntile(6) over (order by id) as t")
    for r in df.withColumn("got", ntile_of(F.col("r"), F.col("n"), 6)).collect():
        assert r.got == r.t


def test_top_per_group_in_parts(spark):
    df = spark.range(3000).select(F.lit("g").alias("g"), "id", (F.col("id") % 10).alias("v"))
    order = [F.desc("v"), F.asc("id")]
    plain = top_per_group(df, ["g"], order, 25)
    parts = top_per_group(df, ["g"], order, 25, spread_by="id")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, parts.collect()))


def strata(spark):
    return spark.range(1237).select(
        F.col("id").alias("essay_id"), F.when(F.col("id") % 10 < 7, "hot").otherwise("cold")
        .alias("prompt_name"), (F.sqrt("id") % 6 + 1).cast("int").alias("score"))


def test_split_is_complete_disjoint_and_exact(spark, many_tasks):
    df = strata(spark)
    got = stratified_split(df)
    assert got.count() == 1237 and got.select("essay_id").distinct().count() == 1237
    sizes = {r.prompt_name: (r.n, r.t) for r in got.groupBy("prompt_name").agg(
        F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    for n, t in sizes.values():
        assert t == -(-n // 5)
    for r in got.groupBy("prompt_name", "score").agg(
            F.count("*").alias("n"), F.sum(F.col("is_test").cast("int")).alias("t")).collect():
        assert abs(r.t - r.n / 5) < 1.5
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stratified_split(df).collect()))


def test_split_of_tiny_groups(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, "b", 4)],
                               "essay_id bigint, prompt_name string, score int")
    got = stratified_split(df).groupBy("prompt_name").agg(
        F.sum(F.col("is_test").cast("int")).alias("t"))
    assert {r.prompt_name: r.t for r in got.collect()} == {"a": 1, "b": 1}


def test_under_sampling_evens_classes(spark):
    got = under_sample(strata(spark), "essay_id", "prompt_name", "score")
    sizes = got.groupBy("prompt_name", "score").count().collect()
    for prompt in ("hot", "cold"):
        assert len({r["count"] for r in sizes if r.prompt_name == prompt}) == 1


def test_class_weight_schemes(spark):
    df = spark.createDataFrame([("p", 1)] * 3 + [("p", 2)], "prompt_name string, score int")
    import math
    for scheme, want in (("exponential", (math.exp(-.75), math.exp(-.25))),
                         ("balanced", (4 / 6, 2.0)), ("root", (math.sqrt(4 / 3), 2.0))):
        got = {r.score: r.weight for r in class_weights(df, scheme=scheme).collect()}
        assert (got[1], got[2]) == pytest.approx(want)
