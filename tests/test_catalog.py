"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest

from gradeloom.catalog import INVENTORY, ORACLES, QUERIES
from tools.check import compare, connect

# Long model runs are covered by test_runs.py.
RUNS = {"baseline_run", "main_run", "experiment_run"}

INVENTORY_IDS = (
    [f"S{i}" for i in range(1, 5)] + [f"P{i}" for i in range(1, 11)] + ["P4b"]
    + [f"J{i}" for i in range(1, 9)] + [f"A{i}" for i in range(1, 14)]
    + [f"W{i}" for i in range(1, 8)] + [f"K{i}" for i in range(1, 5)]
    + [f"X{i}" for i in range(1, 4)] + [f"T{i}" for i in range(1, 25)]
    + [f"I{i}" for i in range(1, 7)] + [f"M{i}" for i in range(1, 11)]
    + [f"E{i}" for i in range(1, 9)])


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in RUNS])
def test_query_matches_sql(spark, con, folder, name):
    assert compare(spark, con, name, folder) == []


def test_every_inventory_row_has_a_query():
    covered = {i for ids in INVENTORY.values() for i in ids.split()}
    assert [i for i in INVENTORY_IDS if i not in covered] == []


def test_oracles_name_registered_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", [
    "set_similarity", "content_word_filter", "filled_essays", "encoded_essays", "stratified_split",
    "weighted_accuracy", "nearest_neighbours", "neighbour_votes", "describe_lineitem",
    "expected_confusion", "text_features", "spelling_errors_by_dictionary"])
def test_no_pairs_of_everything(spark, folder, name):
    plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_reads_needed_columns_only(spark, folder):
    plan = QUERIES["return_flag_counts"](spark, folder)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<l_returnflag:string>" in plan


def test_prompt_filter_reaches_the_scan(spark, folder):
    from gradeloom.sources.tables import table
    df = table(spark, folder, "documents").where("lang = 'en'").select("doc_id")
    assert "EqualTo(lang,en)" in df._jdf.queryExecution().toString()


def test_entry(spark):
    import __spark_entry__ as entry
    assert entry.entry(spark).columns == ["doc_key", "group_key", "similarity"]
    assert entry.queries().keys() >= entry.oracle_sql().keys()
