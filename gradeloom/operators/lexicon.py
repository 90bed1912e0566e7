"""Word tables: tag lexicon, content-word filter, dictionary and unknown words."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from gradeloom.functions.constants import CONTENT_TAGS
from gradeloom.functions.text import gram_runs, word_runs
from gradeloom.operators.ranking import top_per_group
from gradeloom.sources.staging import settle


def build_lexicon(tagged: DataFrame) -> DataFrame:
    """Most frequent tag of each token of ``(token, tag)`` rows; ties go to the smaller tag.

    Rows are counted per (token, tag) first, so a frequent token is a handful of rows by the
    time it is ranked.
    """
    counts = tagged.groupBy("token", "tag").agg(F.count(F.lit(1)).alias("uses"))
    best = top_per_group(counts, ["token"], [F.desc("uses"), F.asc("tag")], 1)
    return best.select("token", "tag", "uses")


def keep_content_words(tokens: DataFrame, lexicon: DataFrame,
                       tags: Sequence[str] = CONTENT_TAGS, keep_unknown: bool = False) -> DataFrame:
    """Token table reduced to tokens whose lexicon tag is kept; order and empty rows stay.

    Stage the lexicon: its size decides between broadcast and shuffled join. The regrouped
    list is one document's tokens, never more than the document held before.
    """
    occurrences = tokens.select("doc_key", F.posexplode("tokens").alias("pos", "token"))
    if keep_unknown:
        rejected = lexicon.where(~F.col("tag").isin(list(tags))).select("token")
        kept = occurrences.join(rejected, "token", "left_anti")
    else:
        accepted = lexicon.where(F.col("tag").isin(list(tags))).select("token")
        kept = occurrences.join(accepted, "token", "left_semi")
    ordered = kept.groupBy("doc_key").agg(
        F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("kept"))
    return tokens.drop("tokens").join(ordered, "doc_key", "left").select(
        "doc_key", "group_key", "row_key",
        F.coalesce(F.col("kept.token"), F.array().cast("array<string>")).alias("tokens"))


def word_rows(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, token`` for every word run of the lower-cased text."""
    return docs.select(doc, F.explode(word_runs(F.col(text))).alias("token"))


def corpus_dictionary(words: DataFrame, doc: str, min_docs: int = 2) -> DataFrame:
    """``token, docs`` of words used by at least ``min_docs`` documents."""
    per_doc = words.select(doc, "token").distinct()
    return per_doc.groupBy("token").agg(F.count(F.lit(1)).alias("docs")).where(
        F.col("docs") >= min_docs)


def unknown_word_counts(docs: DataFrame, doc: str, text: str,
                        dictionary: DataFrame | None = None) -> DataFrame:
    """Word occurrences outside the dictionary, 0 for a document without any.

    Without a dictionary (column ``token``), a word is known once two documents use it. That
    needs no join: a word whose smallest and largest document agree is unknown, and a frequent
    word is combined on the map side to one row per task. With one, a document's words are counted
    in its row, and the dictionary is staged, so that its true size decides the join.
    """
    if dictionary is None:
        words = word_rows(docs, doc, text)
        rare = words.groupBy("token").agg(
            F.count(F.lit(1)).alias("repeats"), F.min(doc).alias(doc),
            F.max(doc).alias("_other")).where(F.col(doc) == F.col("_other"))
    else:
        known = settle(dictionary.select("token"), "dictionary")
        counted = docs.select(doc, F.explode(gram_runs(word_runs(F.col(text)))).alias("run")).select(
            doc, F.col("run.gram").alias("token"), "run.repeats")
        rare = counted.join(known, "token", "left_anti")
    found = rare.groupBy(doc).agg(F.sum("repeats").alias("unknown_words"))
    return docs.select(doc).join(found, doc, "left").withColumn(
        "unknown_words", F.coalesce("unknown_words", F.lit(0).cast("bigint")))
