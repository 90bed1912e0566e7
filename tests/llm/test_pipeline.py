from collections import Counter
from pathlib import Path

import corpus_pipeline
import pytest

from gradeloom.llm.common import shared_root
from gradeloom.llm.exact_dedup import normalised
from gradeloom.llm.queries import ORACLES, QUERIES

from .plain import Union
from .test_simhash import plain_print


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    base, out = tmp_path_factory.mktemp("pipeline"), []
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out.append(docs)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{base}/{n}")
        docs = spark.read.parquet(f"{base}/{n}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert stages[-1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
                                  "offset"]


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = set(ids(stages[1]))
    toxic = [k for k, t in labels.items() if t]
    clean = [k for k, t in labels.items() if not t]
    assert sum(k in kept for k in toxic) <= .25 * len(toxic)
    assert sum(k in kept for k in clean) >= .95 * len(clean)


def test_copies_go(spark, stages):
    rows = stages[1].select("doc_id", normalised(stages[1]["text"]).alias("t")).collect()
    first = {}
    for r in rows:
        first[r.t] = min(first.get(r.t, r.doc_id), r.doc_id)
    assert ids(stages[2]) == sorted(first.values())


def test_near_copies_go(stages):
    prints = [(r.doc_id, plain_print(r.text)) for r in stages[2].collect()]
    groups = Union(i for i, _ in prints)
    for a, (i, x) in enumerate(prints):
        for j, y in prints[:a]:
            if (x ^ y).bit_count() <= 3:
                groups.join(i, j)
    assert ids(stages[3]) == sorted({groups.find(i) for i, _ in prints})


def test_mixing_copies_no_toxic_document(spark, folder, stages):
    """Toxic documents that the first stage missed stay at most once, labelled or not."""
    toxic = spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").select("doc_id")
    missed = stages[0].join(toxic, "doc_id").orderBy("doc_id").limit(4).select(*stages[0].columns)
    other = missed.withColumn("doc_id", missed["doc_id"] + 10**9)
    known = {r.doc_id for r in missed.collect()}
    docs = stages[3].join(missed.select("doc_id"), "doc_id", "left_anti").select(
        *stages[0].columns).unionByName(missed).unionByName(other)
    times = Counter(ids(corpus_pipeline.mix(spark, docs, folder)))
    assert known and max(times.values()) > 1
    assert all(times[k] <= 1 for r in toxic.collect() for k in (r.doc_id,))
    assert all(times[k + 10**9] <= 1 for k in known)


def test_mixed_documents_are_all_packed(stages):
    assert set(ids(stages[4])) <= set(ids(stages[3]))
    got = stages[5].collect()
    assert sorted(r.doc_id for r in got if r.piece == 0) == ids(stages[4])
    filled = {}
    for r in got:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for items in filled.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 4096


def test_stages_take_awkward_tables(spark, folder, tmp_path):
    texts = [None, "", "a b c d", "a  b c d", "y " * 50_000, "a b c d"]
    rows = [(i if i else None, t, None, None, None, "own") for i, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, "
                                       "n_chars bigint, `_doc` string")
    for table in (docs, docs.where("doc_id > 99")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, folder)
            if name != "best-fit packing":
                assert out.columns == docs.columns
            assert (out.count() > 0) == (table is docs)


def test_run_leaves_its_result_alone(spark, folder, stages):
    home = Path(shared_root(spark).removeprefix("file:"), "llm", spark.sparkContext.applicationId)
    before = set(home.rglob("*.parquet"))
    got = corpus_pipeline.run(spark, folder)
    new = {p for p in set(home.rglob("*.parquet")) - before if p.is_file()}
    assert {p.parent.parent.name.rsplit("-", 1)[0] for p in new} == {"pipeline"}
    assert len({p.parent for p in new}) == 1
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1].collect()))


def test_run_is_registered(spark):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert {n for n in QUERIES} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(n.split("_")[0] for n in QUERIES) == sorted(f"op{n}" for n in range(1, 14))
