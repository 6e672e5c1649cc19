"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelode.llm.decontamination import contaminated
from codelode.llm.html_extraction import extract_main_text
from codelode.llm.language_id import identify_language
from codelode.llm.ngram_join import ngram_jaccard_join
from codelode.llm.packing import best_fit_packing
from codelode.llm.secret_scan import scan_secrets
from codelode.llm.substring_dedup import repeated_passages
from codelode.llm.token_counts import TokenRollup
from codelode.llm.toxicity import score_toxicity
from codelode.llm.vector_search import nearest_neighbours
from codelode.session import load, scratch_folder


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(load(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(load(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and version after changes to all documents.

    Drafts of all documents come first (their last 50 words, in a source of their own), all are revised
    to their texts, one whole source is deleted and inserted again, and a batch is replayed. What remains
    is each document's own count, if every signed delta is right.
    """
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    rollup = TokenRollup(spark, scratch_folder(spark, "rollup"))
    drafts = docs.withColumn("text", F.substring_index("text", " ", -50)).withColumn("source", F.lit("draft"))
    rollup.commit(0, drafts.withColumn("op", F.lit("insert")))
    rollup.commit(1, docs.withColumn("op", F.lit("revise")))
    one = docs.where(F.col("source") == docs.agg(F.min("source")).first()[0])
    rollup.commit(2, one.withColumn("op", F.lit("delete")))
    rollup.commit(3, one.withColumn("op", F.lit("insert")))
    rollup.commit(3, one.withColumn("op", F.lit("insert")))
    return rollup.totals()


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(load(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(load(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(load(spark, sf_dir, "pages"))


def op9_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup, op2_toxicity, op3_ngram_jaccard_join, op4_token_counts, op5_secret_scan, op6_best_fit_packing,
        op7_language_id, op8_html_extraction, op9_vector_search, op10_decontamination,
    )
}

#: Brute force in SQL: all pairs that share a shingle, their transitive closure; all inner products.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard_join": """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0D\\x20]+'), lambda x: x <> '') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS inter FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id AND a.n * 100 >= b.n * 85 AND b.n * 100 >= a.n * 85 GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * inter >= 85 * (na + nb - inter)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
""",
    "op9_vector_search": """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 20
""",
}
