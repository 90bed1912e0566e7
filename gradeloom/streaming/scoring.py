"""Scoring newly arriving documents against a stored list of frequent n-grams.

The list is a static table that the stream joins, and a score is an expression of the joined row:
no aggregation, so no state, no watermark, and rows leave in append mode. The file sink's log and
the checkpoint give each document one row over restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from gradeloom.functions.text import content_tokens
from gradeloom.operators.similarity import gram_lists, row_scores
from gradeloom.sources.staging import stage


def scored_stream(documents: DataFrame, top: DataFrame, doc: str = "essay_id",
                  text: str = "full_text", group: str = "prompt_name") -> DataFrame:
    """Similarity columns of each document of a stream (or a table), given the frequent n-grams."""
    tokens = documents.select(
        F.col(doc).alias("doc_key"), F.col(group).alias("group_key"),
        content_tokens(F.col(text)).alias("tokens"))
    return row_scores(tokens, stage(gram_lists(top), "lists"))


def score_stream(documents: DataFrame, top: DataFrame, out_path: str, checkpoint: str,
                 doc: str = "essay_id", text: str = "full_text",
                 group: str = "prompt_name") -> StreamingQuery:
    """Append similarity rows of all documents that have arrived to ``out_path``, then stop.

    Started again with the same paths it goes on with the files that have come since.
    """
    return (scored_stream(documents, top, doc, text, group).writeStream.format("parquet")
            .outputMode("append").option("checkpointLocation", checkpoint).option("path", out_path)
            .trigger(availableNow=True).start())
