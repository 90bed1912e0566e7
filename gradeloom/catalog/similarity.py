"""n-gram lists, similarity scores and lexicon filters over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradeloom.catalog import sql
from gradeloom.catalog.registry import query
from gradeloom.operators import (
    frequent_grams as fg, lexicon as lx, ngrams as ng, similarity as sm)
from gradeloom.plans.runs import tfidf
from gradeloom.sources.staging import fresh_path, stage
from gradeloom.sources.tables import table
from gradeloom.streaming.scoring import score_stream

GRAMS = sql.with_(sql.tokens(), sql.grams())
TOP = sql.with_(sql.tokens(), sql.grams(), sql.top())
SCORES = sql.with_(sql.tokens(), sql.grams(), sql.top(), sql.matched())
CONTENT_SCORES = sql.with_(
    sql.tokens(), sql.TAGGED, sql.CONTENT, sql.grams("content"), sql.top(),
    sql.matched(docs="content"))


def document_tokens(spark, folder):
    return ng.token_table(table(spark, folder, "documents"), "doc_id", "text", "lang", "doc_id")


def tagged_tokens(tokens):
    """A tagged table: the tag follows from the token's length, and in every third document
    from another rule, so that one token has several tags."""
    tags = F.array(*(F.lit(t) for t in ("NN", "IN", "DT", "JJ", "CC", "VB")))
    shift = F.when(F.col("doc_key") % 3 == 0, 1).otherwise(0)
    return tokens.select("doc_key", F.explode("tokens").alias("token")).select(
        "token", F.element_at(
            tags, ((F.length("token") * 2 + shift) % 6 + 1).cast("int")).alias("tag"))


def content_tokens(spark, folder):
    tokens = stage(document_tokens(spark, folder), "tokens")
    lexicon = stage(lx.build_lexicon(tagged_tokens(tokens)), "lexicon")
    return lx.keep_content_words(tokens, lexicon)


@query("gram_counts", "A4", sql.with_(sql.tokens(), sql.grams(), sql.top()) + """
SELECT group_key, gram, occurrences, first_row, first_pos FROM counts""")
def gram_counts(spark, folder):
    return ng.gram_counts(ng.doc_ngrams(document_tokens(spark, folder)))


@query("top_grams", "K3", TOP + """
SELECT group_key, gram, occurrences, rank FROM top""")
def top_grams(spark, folder):
    counts = ng.gram_counts(ng.doc_ngrams(document_tokens(spark, folder)))
    return ng.top_grams(counts).select("group_key", "gram", "occurrences", "rank")


@query("frequent_grams", "K3 A4", TOP + """
SELECT group_key, gram, occurrences, rank FROM top""")
def frequent_grams(spark, folder):
    # Texts are cut into words once, not in each of the three passes.
    runs = stage(ng.doc_runs(document_tokens(spark, folder)), "runs")
    found = fg.frequent_grams(fg.run_uses(runs))
    return found.select("group_key", "gram", "occurrences", "rank")


@query("gram_matches", "J1", SCORES + """
SELECT doc_key, hits, overlap, own_grams, list_size FROM matched""")
def gram_matches(spark, folder):
    return sm.score_documents(document_tokens(spark, folder)).select(
        "doc_key", "hits", "overlap", "own_grams", "list_size")


@query("bigram_similarity", "T9", SCORES + """
SELECT doc_key, group_key, CASE WHEN list_size = 0 THEN 0.0 ELSE hits::DOUBLE / list_size END
  AS similarity FROM matched""")
def bigram_similarity(spark, folder):
    return sm.score_documents(document_tokens(spark, folder)).select(
        "doc_key", "group_key", "similarity")


@query("set_similarity", "X1 X2 X3", SCORES + """
SELECT doc_key, 2.0::DOUBLE * overlap / nullif(own_grams + list_size, 0) AS dice,
  overlap::DOUBLE / nullif(own_grams + list_size - overlap, 0) AS jaccard,
  CASE WHEN list_size = 0 THEN 0.0 ELSE overlap::DOUBLE / list_size END AS coverage
FROM matched""")
def set_similarity(spark, folder):
    return sm.score_documents(document_tokens(spark, folder)).select(
        "doc_key", "dice", "jaccard", "coverage")


@query("streamed_similarity", "T9 X1 X2", SCORES + """
SELECT doc_key, group_key, hits, overlap, own_grams, list_size,
  CASE WHEN list_size = 0 THEN 0.0 ELSE hits::DOUBLE / list_size END AS similarity,
  2.0::DOUBLE * overlap / nullif(own_grams + list_size, 0) AS dice,
  overlap::DOUBLE / nullif(own_grams + list_size - overlap, 0) AS jaccard,
  CASE WHEN list_size = 0 THEN 0.0 ELSE overlap::DOUBLE / list_size END AS coverage
FROM matched""")
def streamed_similarity(spark, folder):
    """The documents arrive as a stream of files; the lists come from the table as it is."""
    docs = table(spark, folder, "documents")
    counts = ng.gram_counts(ng.doc_ngrams(document_tokens(spark, folder)))
    top = stage(ng.top_grams(counts), "top")
    # As a pattern the path may be one file or a folder of them.
    arriving = spark.readStream.schema(docs.schema).parquet(f"{folder}/documents.parque[t]")
    out, checkpoint = fresh_path(spark, "scores"), fresh_path(spark, "progress")
    score_stream(arriving, top, out, checkpoint, "doc_id", "text", "lang").awaitTermination()
    return spark.read.parquet(out)


@query("token_set_similarity", "X1 X2", """
WITH t AS (SELECT conv_id, turn, role,
    list_distinct(string_split_regex(lower(text), '[^a-z]+')) AS a,
    list_distinct(string_split_regex(lower(role), '[^a-z]+')) AS b FROM conversations)
SELECT conv_id, turn, role,
  2.0::DOUBLE * len(list_intersect(a, b)) / (len(a) + len(b)) AS dice,
  len(list_intersect(a, b))::DOUBLE / (len(a) + len(b) - len(list_intersect(a, b))) AS jaccard
FROM t""")
def token_set_similarity(spark, folder):
    turns = table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.split(F.lower("text"), "[^a-z]+").alias("a"),
        F.split(F.lower("role"), "[^a-z]+").alias("b"))
    return turns.select(
        "conv_id", "turn", "role", sm.array_dice(F.col("a"), F.col("b")).alias("dice"),
        sm.array_jaccard(F.col("a"), F.col("b")).alias("jaccard"))


@query("tag_lexicon", "T6", sql.with_(sql.tokens(), sql.TAGGED) + """
SELECT token, tag, uses FROM lexicon""")
def tag_lexicon(spark, folder):
    return lx.build_lexicon(tagged_tokens(document_tokens(spark, folder)))


@query("content_word_filter", "T5 J8", sql.with_(sql.tokens(), sql.TAGGED, sql.CONTENT) + """
SELECT doc_key, len(tokens)::BIGINT AS tokens, array_to_string(tokens, ' ') AS body
FROM content""")
def content_word_filter(spark, folder):
    return content_tokens(spark, folder).select(
        "doc_key", F.size("tokens").alias("tokens"), F.array_join("tokens", " ").alias("body"))


@query("content_similarity", "T10", CONTENT_SCORES + """
SELECT doc_key, group_key, CASE WHEN list_size = 0 THEN 0.0 ELSE hits::DOUBLE / list_size END
  AS nav_similarity FROM matched""")
def content_similarity(spark, folder):
    return sm.score_documents(content_tokens(spark, folder)).select(
        "doc_key", "group_key", F.col("similarity").alias("nav_similarity"))


@query("tfidf_score", "T11", "SELECT doc_id AS doc_key, 1.0::DOUBLE AS tfidf FROM documents")
def tfidf_score(spark, folder):
    return tfidf(table(spark, folder, "documents").select(F.col("doc_id").alias("doc_key")))


PROMPT_TEXTS = """
prompt_texts AS (
  SELECT ['de', 'en', 'es', 'fr'][item_id % 4 + 1] AS lang, string_agg(text, ' ' ORDER BY item_id)
    AS text FROM benchmark GROUP BY 1)"""
PROMPT_TERMS = sql.tokens("prompt_texts", "lang", "text", "lang", "lang").replace(
    "tokens AS (", "prompts AS (", 1)


@query("prompt_tfidf", "T11", sql.with_(sql.tokens(), PROMPT_TEXTS, PROMPT_TERMS) + """
, terms AS (SELECT doc_key, group_key, token, count(*)::DOUBLE AS uses FROM (
    SELECT doc_key, group_key, unnest(tokens) AS token FROM tokens) GROUP BY ALL)
, docs AS (SELECT token, count(*) AS docs FROM terms GROUP BY token)
, idf AS (SELECT token, ln((1.0 + (SELECT count(*) FROM documents)) / (1.0 + docs)) + 1 AS idf
          FROM docs)
, wanted AS (SELECT group_key, token, count(*) * coalesce(idf,
               ln(1.0 + (SELECT count(*) FROM documents)) + 1) AS wanted FROM (
    SELECT group_key, unnest(tokens) AS token FROM prompts) LEFT JOIN idf USING (token)
    GROUP BY group_key, token, idf)
, norms AS (SELECT group_key, sqrt(sum(wanted * wanted)) AS norm FROM wanted GROUP BY 1)
, sums AS (SELECT doc_key, group_key, sqrt(sum(uses * idf * uses * idf)) AS own,
             sum(uses * idf * wanted) AS dot
           FROM terms JOIN idf USING (token) LEFT JOIN wanted USING (group_key, token) GROUP BY 1, 2)
SELECT t.doc_key, coalesce(round(dot / (own * norm), 6), 0.0) AS tfidf FROM tokens t
LEFT JOIN sums USING (doc_key) LEFT JOIN norms n ON n.group_key = t.group_key""")
def prompt_tfidf(spark, folder):
    lang = F.element_at(F.array(*map(F.lit, ("de", "en", "es", "fr"))),
                        (F.col("item_id") % 4 + 1).cast("int"))
    passages = table(spark, folder, "benchmark").withColumn("lang", lang)
    prompts = ng.token_table(passages, "item_id", "text", "lang", "item_id")
    scores = sm.prompt_tfidf(stage(document_tokens(spark, folder), "tokens"), prompts)
    return scores.select("doc_key", F.round("tfidf", 6).alias("tfidf"))
