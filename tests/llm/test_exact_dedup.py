import hashlib
import re

import pytest
from gradeloom.llm import exact_dedup
from gradeloom.llm.common import Scratch
from gradeloom.llm.exact_dedup import exact_duplicates, without_copies

from .plain import awkward, rows_of

LONG = "word " * 30_000
TEXTS = [None, "", "a b", "a  b", "a\t\nb", "A b", LONG, LONG + "x", LONG + "y", LONG, "x" * 256,
         "x" * 256, "x" * 257, "x" * 512, " ", " ", "é" * 300, "é" * 300, "a b", None, "z"]


def brute(rows):
    groups = {}
    body = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in enumerate(t for _, t in rows)}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(body[i], []).append(key)
    out, seen = [], set()
    for i, (key, _) in enumerate(rows):
        known = [k for k in groups[body[i]] if k is not None]
        keep = min(known) if known else None
        stays = key == keep and (key, body[i]) not in seen
        seen.add((key, body[i]))
        out.append((key, keep, len(groups[body[i]]), stays,
                    hashlib.sha256(body[i].encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("first", [2, 256])
def test_matches_brute_force(spark, first):
    docs = awkward(spark, TEXTS)
    want = brute([(i + 1, t) for i, t in enumerate(TEXTS)])
    assert rows_of(exact_duplicates(docs, first=first, widest=8 * first if first > 2 else 1 << 16),
                   *COLUMNS) == want


def test_repeated_rows_and_missing_ids(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, "c"), (2, "d"), (5, "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(exact_duplicates(docs), *COLUMNS) == brute(rows)
    assert rows_of(without_copies(docs), "doc_id", "text") == sorted(
        [(1, "a"), (None, "b"), (2, "c"), (2, "d")], key=repr)


def test_stage_keeps_columns(spark):
    docs = awkward(spark, TEXTS)
    got = without_copies(docs)
    assert got.columns == docs.columns
    want = [r[0] for r in brute([(i + 1, t) for i, t in enumerate(TEXTS)]) if r[3]]
    assert sorted(r.doc_id for r in got.collect()) == sorted(want)
    assert {r._sha for r in got.collect()} == {"y"}


def test_empty_table(spark):
    docs = awkward(spark, ["a"]).where("doc_id > 5")
    assert exact_duplicates(docs).collect() == [] and without_copies(docs).collect() == []


def test_a_large_group_is_combined_before_the_shuffle(spark, folder):
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same' "
                                        "ELSE concat('text ', id) END AS text")
    got = exact_duplicates(docs).where("text_sha256 = sha2('same', 256)").groupBy("keep_id").count()
    assert [tuple(r) for r in got.collect()] == [(0, 1000)]


def test_rounds_are_logarithmic_in_the_longest_text(spark, monkeypatch):
    """Two copies of 8 MB and one that differs in the last byte: 16 rounds, not one per 64 KB."""
    rounds = []
    write = Scratch.write
    monkeypatch.setattr(exact_dedup.Scratch, "write", lambda self, df, name, **more: (
        rounds.append(name), write(self, df, name, **more))[1])
    docs = spark.range(3).selectExpr(
        "id AS doc_id", "concat(repeat('abcdefg ', 1 << 20), if(id = 1, 'x', 'y')) AS text")
    got = rows_of(exact_duplicates(docs), "doc_id", "keep_id", "group_size", "kept")
    assert got == [(0, 0, 2, True), (1, 1, 1, True), (2, 0, 2, False)]
    assert rounds.count("sizes") == 16
