import re

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import text as tx
from gradeloom.functions.constants import CONNECTIVES, CONTRACTIONS, STOP_WORDS
from gradeloom.operators.features import add_features, rounded

SAMPLES = [
    "", " ", "hello", "Don't stop", "I cannot go, gonna wait", "One. Two?! Three.5 four",
    "butter", "Ünïcode straße wörter, naïve!", "a b　c\x1cd", "x_y __ 12 ½ ²",
    "gimmegimme gimme lemme wannabe wanna gottagotta gotta", "can-not can not cannot",
    "tabs\tand\nlines\r\n\x0b end...", "after afterafter due to as a result thus,thus;",
    "éclair mark", "!!! ??? ...", "a. . b", "it's the end; isn't it",
]


def rows(spark, *columns):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, t string")
    return [r for r in df.orderBy("i").select(*columns).collect()]


def plain_words(text):
    out = []
    for token in re.sub(r"[^\w\s]", "", text.lower()).split():
        pair = next(((h, t) for h, t in CONTRACTIONS if h + t == token), None)
        out += pair or [token]
    return out


def test_stop_words_are_whole():
    assert len(STOP_WORDS) == 179 and len(set(STOP_WORDS)) == 179
    assert len(CONNECTIVES) == 21


def test_tokens_match_plain_python(spark):
    got = rows(spark, tx.content_tokens(F.col("t")).alias("w"))
    stop = set(STOP_WORDS)
    assert [r.w for r in got] == [
        [w for w in plain_words(s) if w not in stop] for s in SAMPLES]


def test_known_token_cases(spark):
    by_text = dict(zip(SAMPLES, (r.w for r in rows(spark, tx.content_tokens(F.col("t")).alias("w")))))
    assert by_text["Don't stop"] == ["dont", "stop"]
    assert by_text["I cannot go, gonna wait"] == ["go", "gon", "na", "wait"]


@pytest.mark.parametrize("n", [2, 3])
def test_ngrams(spark, n):
    words = tx.words(tx.normalise(F.col("t")))
    got = rows(spark, words.alias("w"), tx.ngrams(words, n).alias("joined"),
               tx.ngrams(words, n, joined=False).alias("structs"))
    for r in got:
        want = [tuple(r.w[i:i + n]) for i in range(len(r.w) - n + 1)]
        assert [tuple(g.split(" ")) for g in r.joined] == want
        assert [tuple(s) for s in r.structs] == want


def test_counts_match_plain_python(spark):
    t = F.col("t")
    got = rows(spark, tx.sentence_count(t).alias("s"), tx.word_run_count(t).alias("w"),
               tx.word_char_count(t).alias("c"), tx.connective_count(t).alias("k"),
               tx.blank_word_count(t).alias("b"), tx.occurrences(t, ",").alias("m"))
    for r, s in zip(got, SAMPLES):
        words = re.findall(r"\b\w+\b", s.lower())
        pieces = [p for p in re.split(r"[.!?]+(?=\s+|$)", s) if p.strip()]
        assert (r.s, r.w, r.c) == (len(pieces), len(words), sum(map(len, words))), s
        assert r.k == sum(s.lower().count(c) for c in CONNECTIVES), s
        assert (r.b, r.m) == (len(s.split()), s.count(",")), s


def test_features_of_empty_text(spark):
    df = spark.createDataFrame([(1, ""), (2, "Hi, you.")], "essay_id bigint, full_text string")
    got = {r.essay_id: r for r in rounded(
        add_features(df), ["avg_sentence_length", "avg_word_length"]).collect()}
    assert got[1].avg_sentence_length == 0 and got[1].avg_word_length == 0
    assert got[1].num_spelling_errors == 0 and got[1].num_commas == 0
    assert (got[2].avg_sentence_length, got[2].avg_word_length) == (2.0, 2.5)
    assert got[2].num_spelling_errors == 2


def test_spelling_against_a_dictionary(spark):
    from gradeloom.operators.lexicon import unknown_word_counts
    df = spark.createDataFrame([(1, "good baad baad"), (2, "good")], "d bigint, t string")
    known = spark.createDataFrame([("good",)], "token string")
    got = {r.d: r.unknown_words for r in unknown_word_counts(df, "d", "t", known).collect()}
    assert got == {1: 2, 2: 0}


def test_null_text_reads_as_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tx.content_tokens(F.col("t")).alias("w")).first().w == []


def test_a_costly_rule_is_skipped_where_its_letters_are_missing(spark):
    """The triple-letter pattern is searched only in texts that hold a triple, with equal counts."""
    from gradeloom.functions.text import rule_hits
    from gradeloom.operators.features import DEFAULT_RULES, NEEDED, rule_counts
    patterns = [p for _, p in DEFAULT_RULES]
    assert set(NEEDED) <= set(patterns)
    docs = spark.createDataFrame(
        [("soooo gooood, aaah Xtttx eee",), ("plain words only",), ("",), (None,)], "full_text string")
    counted = rule_counts(docs)
    assert "Contains(" in counted._jdf.queryExecution().analyzed().toString()
    got = counted.withColumn("plain", rule_hits(F.col("full_text"), [p for p in patterns if p in NEEDED]))
    assert [(r.rule_spelling_errors, r.plain) for r in got.collect()] == [(5, 5), (0, 0), (0, 0), (0, 0)]
