"""A training corpus in five stages: toxicity, copies, near copies, mixing, packing.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as
the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm.common import Scratch, scratch_scope
from gradeloom.llm.exact_dedup import without_copies
from gradeloom.llm.mixing import mixed
from gradeloom.llm.packing import pack
from gradeloom.llm.queries import CATEGORIES, TARGETS, category_labels, domain_labels
from gradeloom.llm.simhash import one_of_each
from gradeloom.llm.toxicity import labelled_chain, scored

# Domains of TARGETS that the toxicity stage takes out.
REMOVED = ("toxic",)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain does not call toxic; the chain learns from the labelled ones."""
    chain = labelled_chain(docs, category_labels(spark, sf_dir), CATEGORIES)
    return docs.where(~scored(F.col("text"), chain)["toxic"])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest id."""
    return without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the document with the smallest id."""
    return one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at rates that bring the label classes to their target weights.

    A document may stay out, stay once or come several times. The first stage removes toxic
    documents, so that class has no target here and is only told apart, by what the labelled
    documents were before that stage; what it missed is never copied.
    """
    targets = {d: w for d, w in TARGETS.items() if d not in REMOVED}
    return mixed(docs, domain_labels(spark, sf_dir), targets, removed=REMOVED,
                 examples=spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies),
          ("SimHash near-dedup", drop_near_copies), ("mixing", mix),
          ("best-fit packing", pack_sequences)]

# Classifiers, SimHash and tokenizers have no SQL form; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``.

    Once a stage is written, its predecessor's table and what its operators wrote on the way go.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for n, (_, stage) in enumerate(STAGES):
        before = docs
        with scratch_scope():
            docs = scratch.write(stage(spark, before, sf_dir), f"stage{n}")
        scratch.drop(before)
    return docs
