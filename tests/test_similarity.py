import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gradeloom.functions.text import content_tokens
from gradeloom.operators import ngrams as ng, similarity as sm
from gradeloom.operators.frequent_grams import frequent_grams, gram_uses, run_uses
from gradeloom.operators.lexicon import build_lexicon, keep_content_words
from gradeloom.sources.staging import stage
from gradeloom.sources.tables import table
from gradeloom.streaming.scoring import score_stream, scored_stream


def plain_scores(docs, n):
    """Scores from lists and counters; docs are (id, group, tokens) in row order."""
    out = {}
    for group in {g for _, g, _ in docs}:
        own = [(i, list(zip(t, t[1:]))) for i, g, t in docs if g == group]
        top = [b for b, _ in Counter(b for _, bs in own for b in bs).most_common(n)]
        listed = set(top)
        for i, bs in own:
            both, distinct = len(set(bs) & listed), len(set(bs))
            out[i] = (
                sum(b in listed for b in bs) / len(top) if top else 0,
                2 * both / (distinct + len(top)) if distinct + len(top) else None,
                both / (distinct + len(top) - both) if distinct + len(top) else None)
    return out


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_scores_match_plain_python(spark, folder, n):
    docs = table(spark, folder, "documents")
    tokens = docs.select("doc_id", "lang", content_tokens(F.col("text")).alias("w"))
    want = plain_scores(
        [(r.doc_id, r.lang, r.w) for r in tokens.orderBy("doc_id").collect()], n)
    got = sm.score_documents(ng.token_table(docs, "doc_id", "text", "lang", "doc_id"), n)
    assert {r.doc_key: (r.similarity, r.dice, r.jaccard) for r in got.collect()} == want


def test_dice_follows_from_jaccard(spark, folder):
    docs = table(spark, folder, "documents")
    got = sm.score_documents(ng.token_table(docs, "doc_id", "text", "lang", "doc_id"), 100)
    for r in got.where("own_grams > 0").collect():
        assert r.dice == pytest.approx(2 * r.jaccard / (1 + r.jaccard))


def corpus(spark, texts):
    df = spark.createDataFrame(
        [(i, i, "p", t) for i, t in enumerate(texts)],
        "essay_id bigint, row_id bigint, prompt_name string, full_text string")
    return ng.token_table(df, "essay_id")


def test_documents_without_bigrams_score_zero(spark):
    got = {r.doc_key: r for r in sm.score_documents(
        corpus(spark, ["hello", "", "alpha beta alpha beta"]), 10).collect()}
    assert got[0].similarity == 0 and got[1].similarity == 0
    assert got[2].hits == 3 and got[2].overlap == 2 and got[2].list_size == 2


def test_no_bigrams_anywhere(spark):
    got = sm.score_documents(corpus(spark, ["hello", ""]), 10).collect()
    assert [(r.similarity, r.dice, r.jaccard) for r in got] == [(0, None, None)] * 2


def test_ties_go_to_the_first_seen(spark):
    tokens = corpus(spark, ["zeta yew xray", "bravo alpha"])
    top = ng.top_grams(ng.gram_counts(ng.doc_ngrams(tokens)), 2)
    assert [r.gram for r in top.orderBy("rank").collect()] == ["zeta yew", "yew xray"]


def test_list_from_some_documents_only(spark):
    tokens = corpus(spark, ["alpha beta", "gamma delta"])
    fit = spark.createDataFrame([(0,)], "doc_key bigint")
    got = {r.doc_key: r.similarity for r in sm.score_documents(tokens, 10, fit).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_content_words(spark):
    tagged = spark.createDataFrame(
        [("run", "VB"), ("run", "VB"), ("run", "NN"), ("fast", "RB"), ("whence", "IN")],
        "token string, tag string")
    lexicon = stage(build_lexicon(tagged), "lexicon")
    assert {(r.token, r.tag) for r in lexicon.collect()} == {
        ("run", "VB"), ("fast", "RB"), ("whence", "IN")}
    tokens = corpus(spark, ["run whence run fast odd", "whence"])
    kept = {r.doc_key: r.tokens for r in keep_content_words(tokens, lexicon).collect()}
    assert kept == {0: ["run", "run", "fast"], 1: []}
    open_ended = keep_content_words(tokens, lexicon, keep_unknown=True)
    assert {r.doc_key: r.tokens for r in open_ended.collect()} == {
        0: ["run", "run", "fast", "odd"], 1: []}


def exact_list(uses, n):
    counts = uses.groupBy("group_key", "gram").agg(
        F.count("*").alias("occurrences"), F.min(F.struct("row_key", "pos")).alias("first")).select(
        "group_key", "gram", "occurrences", F.col("first.row_key").alias("first_row"),
        F.col("first.pos").alias("first_pos"))
    return ng.top_grams(counts, n)


@pytest.mark.parametrize("n, cells", [(1, 64), (20, 7), (200, 1 << 15), (100_000, 64)])
def test_frequent_grams_are_those_of_exact_counts(spark, folder, n, cells):
    uses = gram_uses(table(spark, folder, "documents").repartition(5), "lang", "doc_id", "text")
    got = frequent_grams(uses, n, cells)
    assert got.columns == exact_list(uses, n).columns
    assert set(map(tuple, got.collect())) == set(map(tuple, exact_list(uses, n).collect()))


def test_frequent_grams_of_ties_null_groups_and_nothing(spark):
    rows = [(None, i, p, f"g{(i + p) % 30}") for i in range(60) for p in range(3)]
    rows += [("a", i, 0, f"once{i}") for i in range(500)] + [("a", 7, 1, None), ("b", 1, 0, None)]
    uses = spark.createDataFrame(rows, "group_key string, row_key bigint, pos int, gram string")
    for n in (1, 5, 40):
        want = exact_list(uses.where("gram IS NOT NULL"), n)
        assert set(map(tuple, frequent_grams(uses, n, 16).collect())) == set(
            map(tuple, want.collect()))
    assert frequent_grams(uses.where("row_key < 0"), 5).collect() == []


def test_small_list_is_broadcast_and_pruned_before_the_shuffle(spark, folder):
    docs = table(spark, folder, "documents")
    grams = stage(ng.doc_ngrams(ng.token_table(docs, "doc_id", "text", "lang", "doc_id")), "g")
    counts = ng.top_grams(ng.gram_counts(grams))
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 4
    scored = sm.match_counts(grams, stage(counts, "top"))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_document_step_adds_no_exchange(spark, folder):
    docs = table(spark, folder, "documents")
    grams = ng.doc_ngrams(ng.token_table(docs, "doc_id", "text", "lang", "doc_id"))
    assert grams._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_stream_scores_equal_batch_scores(spark, folder, tmp_path):
    docs = table(spark, folder, "documents")
    grams = stage(ng.doc_ngrams(ng.token_table(docs, "doc_id", "text", "lang", "doc_id")), "g")
    top = stage(ng.top_grams(ng.gram_counts(grams), 50), "top")
    batch = sm.similarity_columns(sm.match_counts(grams, top))
    (tmp_path / "in").mkdir()
    docs.repartition(3).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(
        str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        score_stream(stream, top, str(tmp_path / "out"), str(tmp_path / "cp"), "doc_id", "text",
                     "lang").awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.columns == batch.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)


def test_row_scores_need_no_exchange_of_documents(spark, folder):
    docs = table(spark, folder, "documents")
    grams = stage(ng.doc_ngrams(ng.token_table(docs, "doc_id", "text", "lang", "doc_id")), "g")
    top = stage(ng.top_grams(ng.gram_counts(grams), 50), "top")
    scored = scored_stream(docs, top, "doc_id", "text", "lang")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_row_scores_without_list_or_tokens(spark):
    tokens = spark.createDataFrame(
        [(1, None, ["a", "b"]), (2, "none", ["a", "b", "a", "b"]), (3, "p", []),
         (4, "p", ["a", "b", "a", "b"]), (4, "p", ["b", "a"])],
        "doc_key bigint, group_key string, tokens array<string>")
    top = spark.createDataFrame([("p", "a b"), ("p", "x y")], "group_key string, gram string")
    got = sorted((r.doc_key, r.hits, r.overlap, r.own_grams, r.list_size, r.similarity)
                 for r in sm.row_scores(tokens, sm.gram_lists(top)).collect())
    assert got == [(1, 0, 0, 1, 0, 0), (2, 0, 0, 2, 0, 0), (3, 0, 0, 0, 2, 0), (4, 0, 0, 1, 2, 0),
                   (4, 2, 1, 2, 2, 1)]


def _nodes(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_ngrams_are_counted_in_their_row(spark):
    """Neither tables of a task's n-grams nor an exchange: they grew with what a task was given."""
    docs = [(1, "a", 1, "x y x y x y z".split()), (2, "a", 2, []), (3, "b", 3, ["one"])]
    tokens = spark.createDataFrame(
        docs, "doc_key bigint, group_key string, row_key bigint, tokens array<string>")
    counted = ng.doc_ngrams(tokens)
    assert "Aggregate" not in _nodes(counted) and "Exchange" not in _nodes(counted)
    assert sorted((tuple(r) for r in counted.collect()), key=str) == sorted([
        (1, "a", 1, "x y", 3, 0), (1, "a", 1, "y x", 2, 1), (1, "a", 1, "y z", 1, 5),
        (2, "a", 2, None, 0, None), (3, "b", 3, None, 0, None)], key=str)


@pytest.mark.parametrize("held", [1, 7, 1 << 16])
def test_counts_are_cut_in_their_task(spark, monkeypatch, held):
    """Counts beyond n per task and group are not shuffled again, whatever comes first."""
    monkeypatch.setattr(ng, "HELD_ROWS", held)
    rows = [(g, f"{g} {i}", 1 + (i * 7) % 5, None if i % 11 == 0 else i % 9, i) for i in range(200)
            for g in ("a", "b", None)] + [("few", "only one", 1, 0, 0)]
    counts = spark.createDataFrame(
        rows, "group_key string, gram string, occurrences bigint, first_row bigint, first_pos int"
    ).repartition(3)
    fewer = counts.mapInArrow(ng._task_top(4), counts.schema)
    assert fewer.count() <= 3 * 3 * 4 + 1
    got = sorted((str(r.group_key), r["rank"], r.gram) for r in ng.top_grams(counts, 4).collect())
    want = []
    for g in ("a", "b", None, "few"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (
            -r[2], r[3] is not None, r[3] or 0, r[4]))
        want += [(str(g), i + 1, r[1]) for i, r in enumerate(own[:4])]
    assert got == sorted(want)


def test_tasks_grow_with_the_input(spark, folder, monkeypatch):
    from gradeloom.sources import tables
    docs = tables.table(spark, folder, "documents")
    monkeypatch.setattr(tables, "TASK_BYTES", 1000)
    tokens = ng.token_table(docs, "doc_id", "text", "lang", "doc_id")
    assert tokens.rdd.getNumPartitions() >= 100


def test_terms_of_a_document_are_counted_in_its_row(spark):
    """tf-idf must not exchange a row per document and term before it weighs them."""
    tokens = spark.createDataFrame(
        [(1, "a", 1, "x y x".split()), (2, "a", 2, ["y"]), (3, "b", 3, [])],
        "doc_key bigint, group_key string, row_key bigint, tokens array<string>")
    scored = sm.prompt_tfidf(tokens, tokens.where("doc_key = 2"))
    plan = _nodes(scored)
    assert not re.search(r"hashpartitioning\(doc_key#\d+L?, group_key#\d+, token", plan)
    got = {r.doc_key: round(r.tfidf, 6) for r in scored.collect()}
    weights = {"x": 2 * (math.log(4 / 2) + 1), "y": math.log(4 / 3) + 1}
    assert got == {1: round(weights["y"] / math.hypot(*weights.values()), 6), 2: 1.0, 3: 0.0}


def test_inverse_frequencies_come_from_the_given_documents(spark):
    tokens = spark.createDataFrame(
        [(1, "a", 1, ["x", "y"]), (2, "a", 2, ["y"]), (3, "a", 3, ["y", "z"])],
        "doc_key bigint, group_key string, row_key bigint, tokens array<string>")
    scored = sm.prompt_tfidf(tokens, tokens.where("doc_key = 3"), tokens.where("doc_key < 3").select("doc_key"))
    x, y, z = (math.log(3 / (1 + docs)) + 1 for docs in (1, 2, 0))
    norm = math.hypot(y, z)
    assert {r.doc_key: r.tfidf for r in scored.collect()} == pytest.approx(
        {1: y * y / math.hypot(x, y) / norm, 2: y / norm, 3: 1})


def test_words_outside_a_dictionary_are_counted_in_their_row(spark):
    from gradeloom.operators.lexicon import unknown_word_counts
    docs = spark.createDataFrame([(1, "Ab ab, cd"), (2, "cd"), (3, None)], "id bigint, body string")
    known = spark.createDataFrame([("cd",), ("cd",)], "token string")
    counted = unknown_word_counts(docs, "id", "body", known)
    assert not re.search(r"hashpartitioning\(id#\d+L?, token", _nodes(counted))
    assert {r.id: r.unknown_words for r in counted.collect()} == {1: 2, 2: 0, 3: 0}


def test_uses_are_one_row_for_a_document_and_ngram(spark):
    """Three passes read these rows; the first place is a plain column, combined by hash."""
    tokens = spark.createDataFrame(
        [(1, "p", 1, "red blue red blue red".split()), (2, "p", 2, ["red", "blue"])],
        "doc_key bigint, group_key string, row_key bigint, tokens array<string>")
    uses = run_uses(ng.doc_runs(tokens))
    assert sorted(map(tuple, uses.collect())) == [
        ("p", 1, 0, "red blue", 2), ("p", 1, 1, "blue red", 2), ("p", 2, 0, "red blue", 1)]
    assert [(r.gram, r.occurrences, r.first_row, r.first_pos)
            for r in frequent_grams(uses, 2, 16).orderBy("rank").collect()] == [
        ("red blue", 3, 1, 0), ("blue red", 2, 1, 1)]


@pytest.mark.parametrize("n, top, chars", [(1, 7, 20_000), (2, 1, 1 << 24), (2, 50, 30_000), (3, 10_000, 5_000)])
def test_lists_from_cells_are_those_of_all_counts(spark, folder, n, top, chars):
    docs = table(spark, folder, "documents")
    tokens = ng.token_table(docs, "doc_id", "text", "lang", "doc_id")
    bodies = stage(ng.token_bodies(tokens), "bodies")
    counts = stage(ng.gram_counts(ng.doc_ngrams(tokens, n)), "counts")
    some = stage(ng.listed_counts(bodies, top, n, chars), "some")
    assert set(map(tuple, ng.top_grams(some, top).collect())) == set(
        map(tuple, ng.top_grams(counts, top).collect()))
    assert top > 1000 or some.count() < counts.count() / 10
    every = ng.gram_counts(ng.task_grams(bodies, n, chars=chars))
    assert every.exceptAll(counts).isEmpty() and counts.exceptAll(every).isEmpty()


def test_scores_of_null_groups_ties_and_empty_documents(spark):
    rows = [(i, None if i % 3 == 0 else f"g{i % 2}", i, [f"w{(i + p) % 9}" for p in range(i % 7)])
            for i in range(60)] + [(60, "g0", 60, None), (61, "alone", 61, ["w1"])]
    tokens = spark.createDataFrame(
        rows, "doc_key bigint, group_key string, row_key bigint, tokens array<string>").repartition(5)
    for n in (1, 3, 100):
        grams = stage(ng.doc_ngrams(tokens), "grams")
        top = stage(ng.top_grams(ng.gram_counts(grams), n), "top")
        want = sm.similarity_columns(sm.match_counts(grams, top))
        assert sorted(map(tuple, sm.score_documents(tokens, n).collect()), key=repr) == sorted(
            map(tuple, want.collect()), key=repr)
