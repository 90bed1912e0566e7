"""Text operators over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.functions import text as tx
from gradeloom.functions.constants import CONNECTIVES
from gradeloom.operators import features as ft, lexicon as lx
from gradeloom.sources.tables import spread, table

def body():
    return F.col("text")

WORDS = f"regexp_extract_all(lower(text), '[{sql.WORD}]+')"
SENTENCES = (f"len(list_filter(string_split_regex(text, '[.!?]+([{sql.BLANK}]+|$)'), "
             f"lambda s: regexp_matches(s, '[^{sql.BLANK}]')))::BIGINT")
WORD_CHARS = f"length(regexp_replace(lower(text), '[^{sql.WORD}]+', '', 'g'))::BIGINT"


def documents(spark, folder):
    return spread(table(spark, folder, "documents"), "doc_id")


def sql_count(text: str, needle: str) -> str:
    return (f"((length({text}) - length(replace({text}, '{needle}', ''))) "
            f"// {len(needle)})::BIGINT")


def sql_hits(patterns) -> str:
    return " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in patterns)


CONNECTIVE_SUM = " + ".join(sql_count("lower(text)", c) for c in CONNECTIVES)
PUNCTUATION_COLUMNS = ", ".join(
    f"{sql_count('text', mark)} AS {name}" for name, mark in tx.PUNCTUATION.items())
SPELLING_RULES = [p for n, p in ft.DEFAULT_RULES if n.startswith(ft.SPELLING_PREFIX)]
GRAMMAR_RULES = [p for n, p in ft.DEFAULT_RULES if not n.startswith(ft.SPELLING_PREFIX)]


@query("normalised_text", "T1 T23", f"SELECT doc_id, {sql.normalised('text')} AS body FROM documents")
def normalised_text(spark, folder):
    return documents(spark, folder).select("doc_id", tx.normalise(body()).alias("body"))


@query("tokenised_text", "T2", f"""
SELECT doc_id, len(w)::BIGINT AS tokens, array_to_string(w, ' ') AS body
FROM (SELECT doc_id, {sql.words('text')} AS w FROM documents)""")
def tokenised_text(spark, folder):
    tokens = tx.words(tx.split_contractions(tx.normalise(body())))
    return documents(spark, folder).select("doc_id", tokens.alias("w")).select(
        "doc_id", F.size("w").alias("tokens"), F.array_join("w", " ").alias("body"))


@query("stop_word_filter", "T3 J7", f"""
SELECT token, count(*) AS uses FROM (SELECT unnest({sql.content_tokens('text')}) AS token
FROM documents) GROUP BY token""")
def stop_word_filter(spark, folder):
    kept = tx.drop_stop_words(tx.words(tx.split_contractions(tx.normalise(body()))))
    return documents(spark, folder).select(F.explode(kept).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("uses"))


@query("preprocessed_text", "T4", f"""
SELECT doc_id, len(w)::BIGINT AS tokens, array_to_string(w, ' ') AS body
FROM (SELECT doc_id, {sql.content_tokens('text')} AS w FROM documents)""")
def preprocessed_text(spark, folder):
    return documents(spark, folder).select("doc_id", tx.content_tokens(body()).alias("w")).select(
        "doc_id", F.size("w").alias("tokens"), F.array_join("w", " ").alias("body"))


@query("conversation_tokens", "T4", f"""
SELECT role, count(*) AS turns, sum(len({sql.content_tokens('text')}))::BIGINT AS tokens
FROM conversations GROUP BY role""")
def conversation_tokens(spark, folder):
    turns = spread(table(spark, folder, "conversations"), "conv_id")
    return turns.select("role", F.size(tx.content_tokens(body())).alias("n")).groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), F.sum("n").alias("tokens"))


@query("doc_bigrams", "T7", sql.with_(sql.tokens(), sql.grams()) + """
SELECT doc_key, pos, split_part(gram, ' ', 1) AS w1, split_part(gram, ' ', 2) AS w2 FROM grams""")
def doc_bigrams(spark, folder):
    pairs = tx.ngrams(tx.content_tokens(body()), 2, joined=False)
    return documents(spark, folder).select(
        F.col("doc_id").alias("doc_key"), F.posexplode(pairs).alias("pos", "g")).select(
        "doc_key", "pos", "g.w1", "g.w2")


@query("doc_trigrams", "T8", sql.with_(sql.tokens()) + """
SELECT doc_key, pos, tokens[pos + 1] || ' ' || tokens[pos + 2] || ' ' || tokens[pos + 3] AS gram
FROM (SELECT *, unnest(range(0, len(tokens) - 2)) AS pos FROM tokens)""")
def doc_trigrams(spark, folder):
    return documents(spark, folder).select(
        F.col("doc_id").alias("doc_key"),
        F.posexplode(tx.ngrams(tx.content_tokens(body()), 3)).alias("pos", "gram"))


@query("sentence_counts", "T12", f"SELECT doc_id, {SENTENCES} AS sentences FROM documents")
def sentence_counts(spark, folder):
    return documents(spark, folder).select("doc_id", tx.sentence_count(body()).alias("sentences"))


@query("word_run_counts", "T13", f"""
SELECT doc_id, len({WORDS})::BIGINT AS words, {WORD_CHARS} AS word_chars FROM documents""")
def word_run_counts(spark, folder):
    return documents(spark, folder).select(
        "doc_id", tx.word_run_count(body()).alias("words"),
        tx.word_char_count(body()).alias("word_chars"))


@query("text_averages", "T14 T15", f"""
SELECT doc_id, CASE WHEN s = 0 THEN 0.0 ELSE w::DOUBLE / s END AS avg_sentence_length,
  CASE WHEN w = 0 THEN 0.0 ELSE c::DOUBLE / w END AS avg_word_length
FROM (SELECT doc_id, {SENTENCES} AS s, len({WORDS}) AS w, {WORD_CHARS} AS c FROM documents)""")
def text_averages(spark, folder):
    counted = ft.text_counts(documents(spark, folder).select("doc_id", "text"), "text")
    return counted.select(
        "doc_id",
        tx.ratio_or_zero(F.col("num_words"), F.col("num_sentences")).alias("avg_sentence_length"),
        tx.ratio_or_zero(F.col("num_word_chars"), F.col("num_words")).alias("avg_word_length"))


@query("punctuation_counts", "T16", f"SELECT doc_id, {PUNCTUATION_COLUMNS} FROM documents")
def punctuation_counts(spark, folder):
    return documents(spark, folder).select("doc_id", *(
        tx.occurrences(body(), mark).alias(name) for name, mark in tx.PUNCTUATION.items()))


@query("connective_counts", "T17", f"""
SELECT doc_id, ({CONNECTIVE_SUM})::BIGINT AS num_connectives FROM documents""")
def connective_counts(spark, folder):
    return documents(spark, folder).select(
        "doc_id", tx.connective_count(body()).alias("num_connectives"))


UNKNOWN = f"""
words AS (SELECT doc_id, unnest({WORDS}) AS token FROM documents),
unknown AS (
  SELECT doc_id, count(*) AS unknown_words FROM words
  WHERE token IN (SELECT token FROM words GROUP BY token HAVING count(DISTINCT doc_id) < 2)
  GROUP BY doc_id)"""


@query("spelling_errors", "T18", sql.with_(UNKNOWN) + """
SELECT doc_id, coalesce(unknown_words, 0) AS num_spelling_errors
FROM documents LEFT JOIN unknown USING (doc_id)""")
def spelling_errors(spark, folder):
    return lx.unknown_word_counts(documents(spark, folder), "doc_id", "text").withColumnRenamed(
        "unknown_words", "num_spelling_errors")


@query("spelling_errors_by_dictionary", "T18", f"""
WITH words AS (SELECT doc_id, unnest({WORDS}) AS token FROM documents),
known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[{sql.WORD}]+')) AS token
          FROM conversations)
, unknown AS (SELECT doc_id, count(*) AS n FROM words
  WHERE token NOT IN (SELECT token FROM known) GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS num_spelling_errors FROM documents LEFT JOIN unknown USING (doc_id)
""")
def spelling_errors_by_dictionary(spark, folder):
    turns = spread(table(spark, folder, "conversations"), "conv_id")
    known = lx.word_rows(turns, "conv_id", "text").select("token").distinct()
    return lx.unknown_word_counts(
        documents(spark, folder), "doc_id", "text", known).withColumnRenamed(
        "unknown_words", "num_spelling_errors")


@query("grammar_errors", "T19", f"""
SELECT doc_id, ({sql_hits(SPELLING_RULES)})::BIGINT AS rule_spelling_errors,
  ({sql_hits(GRAMMAR_RULES)})::BIGINT AS num_grammar_errors FROM documents""")
def grammar_errors(spark, folder):
    return ft.rule_counts(documents(spark, folder).select("doc_id", "text"), "text").drop("text")


@query("text_features", "T20", sql.with_(UNKNOWN) + f"""
SELECT doc_id, CASE WHEN s = 0 THEN 0.0 ELSE w::DOUBLE / s END AS avg_sentence_length,
  CASE WHEN w = 0 THEN 0.0 ELSE c::DOUBLE / w END AS avg_word_length,
  num_commas, num_periods, num_semicolons, num_exclamations, num_questions, num_connectives,
  coalesce(unknown_words, 0) + rules AS num_spelling_errors, num_grammar_errors
FROM (SELECT doc_id, {SENTENCES} AS s, len({WORDS}) AS w, {WORD_CHARS} AS c,
        {PUNCTUATION_COLUMNS}, ({CONNECTIVE_SUM})::BIGINT AS num_connectives,
        ({sql_hits(SPELLING_RULES)})::BIGINT AS rules,
        ({sql_hits(GRAMMAR_RULES)})::BIGINT AS num_grammar_errors
      FROM documents) LEFT JOIN unknown USING (doc_id)""")
def text_features(spark, folder):
    return ft.add_features(
        documents(spark, folder).select("doc_id", "text"), "doc_id", "text").drop("text")


@query("filled_word_counts", "T21", sql.with_(sql.SCORED, sql.ESSAYS, sql.KEPT) + """
SELECT essay_id, essay_word_count FROM kept""")
def filled_word_counts(spark, folder):
    from gradeloom.operators.impute import drop_missing, fill_word_count
    from gradeloom.sources.essays import essay_view
    kept = drop_missing(essay_view(spark, folder), ["full_text"])
    return fill_word_count(kept).select("essay_id", "essay_word_count")


@query("rounded_values", "T22", """
SELECT event_id, CAST(round_even(CAST(value AS DECIMAL(18, 4)) / 3, 2) AS DOUBLE) AS third
FROM events""")
def rounded_values(spark, folder):
    events = table(spark, folder, "events")
    third = events.select("event_id", (F.col("value") / 3).alias("third"))
    return ft.rounded(third, ["third"])


@query("score_mathematics", "T24", """
SELECT event_id, round(exp(-value / 1000.0::DOUBLE), 9) AS decay, (value - user_id) * (value - user_id)
  AS squared, CASE WHEN user_id = 0 THEN NULL ELSE value / user_id END AS quotient
FROM events""")
def score_mathematics(spark, folder):
    v, u = F.col("value"), F.col("user_id")
    return table(spark, folder, "events").select(
        "event_id", F.round(F.exp(-v / 1000.0), 9).alias("decay"), ((v - u) * (v - u)).alias("squared"),
        F.try_divide(v, u).alias("quotient"))
