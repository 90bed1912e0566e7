"""Essay collections: CSV scan, feature table, and the essay view over a document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gradeloom.functions.constants import MAX_SCORE, MIN_SCORE
from gradeloom.functions.text import blank_word_count
from gradeloom.operators.features import FEATURES
from gradeloom.operators.ranking import ntile_of, number_rows
from gradeloom.sources.staging import settle, stage
from gradeloom.sources.tables import spread, table

ESSAY_SCHEMA = T.StructType([
    T.StructField("essay_id", T.LongType()),
    T.StructField("row_id", T.LongType()),
    T.StructField("score", T.LongType()),
    T.StructField("full_text", T.StringType()),
    T.StructField("essay_word_count", T.LongType()),
    T.StructField("assignment", T.StringType()),
    T.StructField("prompt_name", T.StringType()),
    T.StructField("grade_level", T.LongType()),
    T.StructField("economically_disadvantaged", T.StringType()),
    T.StructField("student_disability_status", T.StringType()),
    T.StructField("ell_status", T.StringType()),
    T.StructField("race_ethnicity", T.StringType()),
    T.StructField("gender", T.StringType()),
])


FEATURE_SCHEMA = T.StructType([
    T.StructField("essay_id", T.LongType()),
    *(T.StructField(name, T.DoubleType() if name.startswith("avg_") else T.LongType())
      for name in FEATURES),
    T.StructField("similarity_score", T.DoubleType()),
])
# Cells that stand for a missing value.
MISSING = ("", "NA", "NaN", "nan")


def _typed(name: str, kind: T.DataType):
    cell = F.when(~F.trim(F.col(name)).isin(*MISSING), F.col(name))
    if isinstance(kind, T.LongType):
        # Tools that know no missing integers write 3 as 3.0.
        number = cell.cast("double")
        whole = cell.cast("decimal(38, 0)").cast("bigint")
        return F.when(number == F.floor(number), whole).when(cell.isNotNull(), F.raise_error(
            F.concat(F.lit(f"no whole number in column {name}: "), cell))).alias(name)
    return cell.cast(kind).alias(name)


def read_essays_csv(spark: SparkSession, path: str, schema: T.StructType = ESSAY_SCHEMA) -> DataFrame:
    """Header CSV with quoted, possibly multi-line texts, read by column name.

    Columns may stand in any order, further ones are left out, and a missing one is an error,
    except ``row_id``, which is then the position in file order (files by name). Empty cells and
    ``NA``, ``NaN``, ``nan`` are null; a number that is none fails the job, as does one with decimals
    in a column of whole numbers (3.0 counts as whole). ``essay_id`` stays
    text if any id is no whole number. Quoted line breaks make a single CSV file unsplittable:
    ship many files, or convert to parquet once.
    """
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"')
           .option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
           .csv(path))
    fields = {f.name: f.dataType for f in schema.fields}
    absent = [n for n in fields if n not in raw.columns and n != "row_id"]
    if absent:
        raise ValueError(f"columns missing in {path}: {', '.join(absent)}")
    if isinstance(fields.get("essay_id"), T.LongType):
        words = F.col("essay_id").isNotNull() & F.col("essay_id").try_cast("bigint").isNull()
        if not raw.where(words & ~F.trim("essay_id").isin(*MISSING)).isEmpty():
            fields["essay_id"] = T.StringType()
    held = [_typed(n, kind) for n, kind in fields.items() if n in raw.columns]
    if "row_id" not in fields or "row_id" in raw.columns:
        return raw.select(*held)
    placed = stage(raw.select(*held, F.col("_metadata.file_path").alias("_file"),
                              F.monotonically_increasing_id().alias("_at")), "csv")
    rank = number_rows(placed.select("_file", "_at"), [], ["_file", "_at"], rank="row_id")
    return placed.join(rank.drop("_file"), "_at").select(*fields)


def read_features_csv(spark: SparkSession, path: str) -> DataFrame:
    """A ready feature table for the runs: essay_id, the ten features, similarity_score."""
    return read_essays_csv(spark, path, FEATURE_SCHEMA)


def write_essays_csv(essays: DataFrame, path: str) -> None:
    (essays.write.option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


def scored_documents(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, lang, score``: the score is the sixth of its language a document falls in by
    length, ranked on narrow rows over all tasks."""
    docs = table(spark, folder, "documents").select("doc_id", "lang", "n_chars")
    ranks = number_rows(docs, ["lang"], ["n_chars", "doc_id"], total="size")
    return settle(ranks.select(
        "doc_id", "lang", ntile_of(F.col("rank"), F.col("size"), 6).alias("score")), "scores")


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    """Rating pairs over the documents: ``essay_id, prompt_name, score, predicted``."""
    shifted = F.col("score") + F.col("doc_id") % 3 - 1
    return scored_documents(spark, folder).select(
        F.col("doc_id").alias("essay_id"), F.col("lang").alias("prompt_name"), "score",
        F.least(F.lit(MAX_SCORE), F.greatest(F.lit(MIN_SCORE), shifted)).cast("bigint")
        .alias("predicted"))


def essay_view(spark: SparkSession, folder: str) -> DataFrame:
    """Essays over ``documents``, with nulls set on purpose."""
    docs = spread(table(spark, folder, "documents"), "doc_id")
    scores = scored_documents(spark, folder).select("doc_id", "score")
    i = F.col("doc_id")

    def unless(missing, value):
        return F.when(missing, F.lit(None)).otherwise(value)

    return docs.join(scores, "doc_id", "left").select(
        i.alias("essay_id"), i.alias("row_id"), "score",
        unless(i % 97 == 11, F.col("text")).alias("full_text"),
        unless(i % 13 == 4, blank_word_count(F.col("text"))).alias("essay_word_count"),
        unless((i % 17 == 5) | (i % 101).isin(40, 41),
               F.concat("lang", F.lit("_"), "source")).alias("assignment"),
        unless((i % 31 == 8) | (i % 101 == 41), F.col("lang")).alias("prompt_name"),
        unless((i % 23).isin(7, 8), F.lit(6) + i % 7).cast("bigint").alias("grade_level"),
        unless(i % 19 == 3, F.when(i % 2 == 0, "Economically disadvantaged").otherwise("Other"))
        .alias("economically_disadvantaged"),
        unless(i % 29 == 6, F.when(i % 5 == 0, "Identified as having disability")
               .otherwise("Not identified as having disability"))
        .alias("student_disability_status"),
        unless(i % 37 == 9, F.when(i % 4 == 0, "Yes").otherwise("No")).alias("ell_status"),
        unless(i % 41 == 2, F.concat(F.lit("group"), (i % 6).cast("string")))
        .alias("race_ethnicity"),
        unless(i % 43 == 1, F.when(i % 3 == 0, "M").otherwise("F")).alias("gender"))
