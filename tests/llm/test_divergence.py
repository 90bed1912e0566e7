import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gradeloom.llm import divergence as dv

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]
TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top=10):
    """rows: lang, source, text."""
    groups, langs, docs = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")))
        groups[lang, source].update(found)
        langs[lang].update(found)
        docs[lang].update(set(found))
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def shares(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) * (p - q) // (p + q)

        p, q = shares(own), shares(langs[lang])
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                s = shares(groups[lang, other])
                pairs.append((other, sum(f(p[t], s[t]) for t in kept)))
        found = [(t, f(p[t], q[t])) for t in kept if own[t] > 0 and p[t] > q[t]]
        for part, items, n in (("pair", pairs, None), ("term", found, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, t, v, i + 1) for i, (t, v) in enumerate(items[:n])]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


TEXTS = [None, "", "The cat, the CAT", "Über über ÜBER naïve", "a1b2c3 漢字。漢字", "cat\x00dog\x7Fbird",
         "dog " * 40_000, "same words here", "same words here", "zeta eta theta", "x-y_z{q}"]


@pytest.mark.parametrize("bits", [64, 3])
@pytest.mark.parametrize("min_docs", [1, 3])
def test_awkward_documents(spark, bits, min_docs):
    rows = [(None if i % 5 == 0 else ("en", "de")[i % 2], None if i % 7 == 0 else f"s{i % 3}",
             t) for i, t in enumerate(TEXTS * 4)]
    docs = spark.createDataFrame([(i % 9, *r, "x", 1, 2) for i, r in enumerate(rows)],
                                 "doc_id bigint, lang string, source string, text string, "
                                 "part string, gid bigint, digest bigint")
    want = brute(rows, min_docs)
    assert {w[2] for w in want} == {"pair", "term"}
    assert result(dv.source_divergence(docs, min_docs, digest_bits=bits)) == want


def test_empty_table_and_no_kept_terms(spark):
    docs = spark.createDataFrame([("en", "a", "one"), ("en", "b", "two"), ("de", "a", None)],
                                 "lang string, source string, text string")
    assert dv.source_divergence(docs.where("lang = 'x'")).collect() == []
    assert result(dv.source_divergence(docs)) == [
        ("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_ties_go_by_text(spark):
    words = [f"w{i:02d}é" for i in range(40)]
    rows = [("en", "a", " ".join(words))] * 2 + [("en", "b", "w00é")] * 2
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(dv.source_divergence(docs, 1)) == brute(rows, 1)


def test_large_counts_stay_exact(spark):
    row = spark.range(1).select(
        dv.share(F.lit(3 * 10**14), F.lit(10**16), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (3 * 10**14 + 2) // (10**16 + 2 * 10**9)


def test_many_sources_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(dv, "TILE", 4)
    rows = [("en", f"s{i % 11:02d}", f"w{i % 5} w{i % 7} w{i % 3}") for i in range(200)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    assert result(dv.source_divergence(docs, 2)) == brute(rows, 2)


def test_counts_are_shuffled_without_terms(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("lang", "source", "text")
    found = dv.Scratch(spark, "test").write(dv.term_rows(docs, 0), "terms")
    counts = found.groupBy("lid", "gid", "digest").agg(F.sum("n"), F.sum("docs"))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<lid:bigint,gid:bigint,digest:bigint,n:bigint,docs:bigint>" in plan


def test_tables_that_no_later_step_reads_are_dropped(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("gradeloom.llm.common.shared_root", lambda _: str(tmp_path))
    docs = spark.createDataFrame([("en", f"s{i % 2}", "same words") for i in range(4)],
                                 "lang string, source string, text string")
    assert dv.source_divergence(docs, 1).count() == 2
    left = {path.name.rsplit("-", 1)[0] for path in tmp_path.glob("llm/*/*/*")}
    assert "rows" in left and not left & {"terms", "counts", "candidates"}
