"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.llm.common import documents
from gradeloom.llm.divergence import source_divergence
from gradeloom.llm.exact_dedup import exact_duplicates
from gradeloom.llm.fill_middle import fill_in_middle, restored
from gradeloom.llm.html_extract import extract_text
from gradeloom.llm.jaccard_join import similar_documents
from gradeloom.llm.license_scan import license_notices
from gradeloom.llm.mixing import soft_mix
from gradeloom.llm.packing import pack
from gradeloom.llm.simhash import near_duplicates
from gradeloom.llm.suffix_dedup import remove_repeats
from gradeloom.llm.token_counts import token_counts
from gradeloom.llm.topk_search import top_k, usable
from gradeloom.llm.toxicity import toxicity

CATEGORIES = ("low_quality", "toxic")
# Weights of the label classes in the mix.
TARGETS = {"high": 0.90, "low": 0.08, "toxic": 0.02}


def category_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and one 0/1 column per category of the chain."""
    return spark.read.parquet(f"{folder}/labels.parquet").select(
        "doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and the domain of each labelled document."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").otherwise("low")
    return spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", domain.alias("domain"))


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{folder}/pages.parquet"))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_notices(documents(spark, folder))


def op3_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(documents(spark, folder))


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return soft_mix(documents(spark, folder), domain_labels(spark, folder), TARGETS)


def op5_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(documents(spark, folder))


def op6_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(documents(spark, folder))


def op7_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").where(usable(F.col("embedding")))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(64.0) * x.cast("double")))
    return top_k(rows.select("vec_id", whole.alias("values")), "vec_id % 20 = 0")


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), category_labels(spark, folder), CATEGORIES)


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))


def op11_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(documents(spark, folder))


def op12_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return similar_documents(documents(spark, folder))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    made = fill_in_middle(documents(spark, folder))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_html_extraction, op2_license_scan, op3_suffix_dedup, op4_mixing,
        op5_simhash_near_dedup, op6_exact_dedup, op7_topk_search, op8_token_counts, op9_toxicity,
        op10_packing, op11_source_divergence, op12_jaccard_join, op13_fill_in_middle)}

ORACLES = {
    "op6_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')
                   AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = min(doc_id) OVER g AS kept, sha256(body) AS text_sha256
        FROM t WINDOW g AS (PARTITION BY body)""",
    "op7_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS w
                   FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.w, c.w)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
        SELECT query_id, rank, vec_id, score FROM (
            SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER
                   AS rank FROM s) WHERE rank <= 20""",
    "op11_source_divergence": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms,
                   row_number() OVER () AS row FROM documents),
        g AS (SELECT DISTINCT lang, source FROM t),
        w AS (SELECT lang, source, row, unnest(terms) AS term FROM t),
        kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term
                 HAVING count(DISTINCT row) >= 10),
        lang_total AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
        uses AS (SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0) AS n
                 FROM g JOIN kept k USING (lang) LEFT JOIN (
                     SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) c
                 USING (lang, source, term)),
        totals AS (SELECT lang, source, sum(n) AS total FROM uses GROUP BY ALL),
        p AS (SELECT u.lang, u.source, u.term, u.n,
              (1 + (1000000000::HUGEINT * (u.n + 2)) // (s.total + 2 * l.v)::HUGEINT) AS p,
              (1 + (1000000000::HUGEINT * (u.lang_n + 2)) // (l.total + 2 * l.v)::HUGEINT) AS q
              FROM uses u JOIN totals s USING (lang, source) JOIN lang_total l USING (lang)),
        pair_sum AS (SELECT a.lang, a.source, b.source AS item,
                     sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
                     FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
                     GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN pair_sum s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
        term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value
                 FROM p WHERE n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
            FROM (SELECT 'pair' AS part, * FROM pair UNION ALL SELECT 'term' AS part, * FROM term))
        WHERE part = 'pair' OR rank <= 10""",
    "op12_jaccard_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (SELECT doc_id, row, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4
                   THEN [array_to_string(words, ' ')] ELSE list_distinct(list_transform(
                       range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams
              FROM w),
        e AS (SELECT row, len(grams) AS size, unnest(grams) AS gram FROM s),
        links AS (SELECT a.row AS x, b.row AS y FROM e a JOIN e b ON a.gram = b.gram AND a.row <> b.row
                  GROUP BY a.row, b.row, a.size, b.size
                  HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
        reach AS (SELECT row AS x, row AS y FROM s
                  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT s.doc_id, len(s.grams) AS n_shingles, min(t.doc_id) AS component_id
        FROM reach r JOIN s ON s.row = r.x JOIN s t ON t.row = r.y GROUP BY s.row, s.doc_id, s.grams""",
    "op13_fill_in_middle": r"""
        WITH u AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h,
                   regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS w FROM documents),
        d AS (SELECT doc_id, t, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS x,
              ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS y,
              CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                     OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
                   WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        c AS (SELECT *, array_to_string(w[1:least(x, y)], '') AS pre,
              array_to_string(w[least(x, y) + 1:greatest(x, y)], '') AS mid,
              array_to_string(w[greatest(x, y) + 1:], '') AS suf FROM d)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('<P>', pre, '<S>', suf, '<M>', mid)
                      ELSE concat('<S>', suf, '<P>', pre, '<M>', mid) END) AS output_sha256,
               sha256(t) AS restored_sha256 FROM c""",
}
