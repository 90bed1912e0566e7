import os

import pytest
from pyspark.sql import functions as F

from gradeloom.operators.ngrams import top_grams
from gradeloom.operators.split import stratified_split
from gradeloom.sources import staging
from gradeloom.sources.essays import ESSAY_SCHEMA, read_essays_csv, read_features_csv
from gradeloom.sources.results import append_results

COLUMNS = [f.name for f in ESSAY_SCHEMA.fields if f.name != "row_id"]
ROW = {"essay_id": "7", "score": "3", "full_text": "one, two", "essay_word_count": "2", "grade_level": "8"}


def csv(folder, columns, *rows, name="a.csv"):
    def quoted(x):
        return '"' + str(x).replace('"', '""') + '"' if x != "" else ""
    lines = [",".join(columns)] + [",".join(quoted(r.get(c, "")) for c in columns) for r in rows]
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder)


def test_columns_are_found_by_name(spark, tmp_path):
    path = csv(tmp_path, ["extra", *reversed(COLUMNS)], ROW, {**ROW, "essay_id": "8", "score": "5"})
    got = read_essays_csv(spark, path).orderBy("row_id").collect()
    assert [(r.essay_id, r.score, r.essay_word_count, r.row_id) for r in got] == [
        (7, 3, 2, 0), (8, 5, 2, 1)]
    assert got[0].full_text == "one, two" and got[0].gender is None
    assert "extra" not in got[0].asDict()


def test_missing_cells_and_text_ids(spark, tmp_path):
    rows = [{**ROW, "essay_id": "A1", "grade_level": "NaN", "gender": "NA"},
            {**ROW, "essay_id": "12", "grade_level": "9.0", "essay_word_count": ""}]
    got = read_essays_csv(spark, csv(tmp_path, COLUMNS, *rows)).orderBy("row_id").collect()
    assert [(r.essay_id, r.grade_level, r.essay_word_count, r.gender) for r in got] == [
        ("A1", None, 2, None), ("12", 9, None, None)]


def test_bad_numbers_and_missing_columns_fail(spark, tmp_path):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_essays_csv(spark, csv(tmp_path, COLUMNS, {**ROW, "score": "high"})).collect()
    with pytest.raises(ValueError, match="gender"):
        read_essays_csv(spark, csv(tmp_path, COLUMNS[:-1], ROW))


def test_whole_numbers_have_no_decimals(spark, tmp_path):
    path = csv(tmp_path, COLUMNS, {**ROW, "score": "3.0", "grade_level": "9007199254740993"})
    got = read_essays_csv(spark, path).first()
    assert (got.score, got.grade_level) == (3, 9007199254740993)
    for n, bad in enumerate(["7.5", "0.1", "Infinity", "1e30"]):
        where = tmp_path / str(n)
        where.mkdir()
        with pytest.raises(Exception):
            read_essays_csv(spark, csv(where, COLUMNS, {**ROW, "score": bad})).collect()


RESULT = "prompt string, model string, metric string, value double"


def test_a_repeated_append_leaves_one_copy(spark, tmp_path):
    path = str(tmp_path / "results")
    first = spark.createDataFrame([("p", "m", "kappa", .12345)], RESULT)
    other = spark.createDataFrame([("p", "m", "kappa", .5), ("q", "m", "kappa", None)], RESULT)
    assert append_results(first, path, run_id="a") == "a"
    named = append_results(other, path)
    append_results(first, path, run_id="a")
    got = sorted((r.run_id == "a", r.prompt, r.value) for r in spark.read.parquet(path).collect())
    assert named != "a" and got == [(False, "p", .5), (False, "q", None), (True, "p", .1235)]
    assert append_results(first.limit(0), path, run_id="b") == "b"
    assert spark.read.parquet(path).count() == 3


def test_a_failed_append_leaves_the_table_as_it_was(spark, tmp_path):
    path = str(tmp_path / "results")
    rows = spark.createDataFrame([("p", "m", "kappa", 1.0)], RESULT)
    append_results(rows, path, run_id="a")
    broken = rows.withColumn("prompt", F.when(F.col("value") == 1, F.raise_error(F.lit("broken"))))
    with pytest.raises(Exception, match="broken"):
        append_results(broken, path, run_id="a")
    assert [tuple(r)[:4] for r in spark.read.parquet(path).collect()] == [("p", "m", "kappa", 1.0)]


def test_rows_are_numbered_in_file_order(spark, tmp_path):
    for n in (2, 0, 1):
        csv(tmp_path, COLUMNS, *({**ROW, "essay_id": 10 * n + i} for i in range(3 + 2 * n)),
            name=f"part{n}.csv")
    got = read_essays_csv(spark, str(tmp_path)).orderBy("row_id").collect()
    assert [r.essay_id for r in got] == [0, 1, 2, 10, 11, 12, 13, 14, *range(20, 27)]
    assert [r.row_id for r in got] == list(range(15))


def test_feature_tables(spark, tmp_path):
    from gradeloom.operators.features import FEATURES
    columns = ["similarity_score", *FEATURES, "essay_id"]
    path = csv(tmp_path, columns, {c: i + 1 for i, c in enumerate(columns)})
    got = read_features_csv(spark, path).first()
    assert (got.essay_id, got.similarity_score, got[FEATURES[0]]) == (12, 1.0, 2.0)


def test_staged_tables_of_others_stay(spark):
    root = staging.shared_dir(spark)
    other = f"{root}/staged/another-application/table"
    os.makedirs(other, exist_ok=True)
    mine = staging.stage(spark.range(3), "mine")
    assert spark.sparkContext.applicationId in mine.inputFiles()[0]
    staging.clear_staged(spark)
    assert os.path.isdir(other) and not os.path.isdir(staging.staged_dir(spark))


def test_a_scope_drops_what_was_staged_in_it(spark):
    before = staging.stage(spark.range(3), "kept")
    with staging.staged_scope(spark):
        inside = staging.stage(spark.range(4), "dropped")
        path = inside.inputFiles()[0].removeprefix("file:").replace("//", "/")
        assert inside.count() == 4 and os.path.exists(path)
    assert before.count() == 3 and not os.path.exists(path)


def test_bucketed_tables_keep_their_rows_and_go_with_their_scope(spark):
    rows = spark.range(100).selectExpr("IF(id < 9, NULL, id) AS id", "CAST(id % 7 AS INT) AS g")
    with staging.staged_scope(spark):
        kept = staging.stage_by(rows, "bucketed", "id")
        assert kept.schema == rows.schema
        assert sorted(map(tuple, kept.collect()), key=repr) == sorted(
            map(tuple, rows.collect()), key=repr)
        assert staging.stage_by(rows.where("id < 0"), "bucketed", "id").collect() == []
        assert len([t for t in spark.catalog.listTables() if "bucketed" in t.name]) == 2
    assert not [t for t in spark.catalog.listTables() if "bucketed" in t.name]
    staging.stage_by(rows, "bucketed", "id")
    staging.clear_staged(spark)
    assert not [t for t in spark.catalog.listTables() if "bucketed" in t.name]
    assert not os.path.exists(staging.staged_dir(spark).removeprefix("file:"))


@pytest.mark.parametrize("n", [1000, 5000])
def test_top_grams_of_any_length(spark, n):
    counts = spark.range(20_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN 'b' ELSE 'a' END AS group_key", "concat('g', id) AS gram",
        "id * 7919 % 20011 AS occurrences", "id AS first_row", "0 AS first_pos")
    got = top_grams(counts, n).groupBy("group_key").agg(
        F.count("*").alias("n"), F.min("occurrences").alias("least")).collect()
    want = {}
    for i in range(20_000):
        want.setdefault("b" if i % 10 == 0 else "a", []).append(i * 7919 % 20011)
    assert {r.group_key: (r.n, r.least) for r in got} == {
        k: (min(n, len(v)), sorted(v)[-min(n, len(v))]) for k, v in want.items()}


def test_the_split_reads_its_source_once(spark, tmp_path):
    spark.range(3000).selectExpr("id AS essay_id", "concat('p', id % 2) AS prompt_name",
                                 "1 + id % 3 AS score").write.parquet(f"{tmp_path}/t")
    split = stratified_split(spark.read.parquet(f"{tmp_path}/t"))
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("essay_id#") and "Union" not in plan
    scans = split._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/t")
    assert scans == 1 and split.where("is_test").count() == 600
