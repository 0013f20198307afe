"""Queries of the corpus operators and the SQL that states their results, where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import spread


def _read(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(_read(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_read(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _read(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, _read(spark, sf_dir, "labels")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_pii

    return find_pii(_read(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_read(spark, sf_dir))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(_read(spark, sf_dir)).select("doc_id", "text", "n_lines", "n_removed")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(_read(spark, sf_dir))


def op8_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .permutation_ann import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_read(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_fm import fit_quality, score_quality

    docs = _read(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, _read(spark, sf_dir, "labels")))


OP1_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
      FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n, list(g ORDER BY g) AS s FROM g GROUP BY doc_id),
b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
p AS (SELECT b.a, b.b, q.s AS s, p.s = q.s AS same FROM b JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
      WHERE shared::DOUBLE / (p.n + q.n - shared) >= 0.5),
r AS (SELECT doc_id, doc_id AS c FROM documents WHERE doc_id IS NOT NULL UNION SELECT p.b, r.c FROM r JOIN p ON p.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS class_id FROM r GROUP BY doc_id),
k AS (SELECT a AS doc_id, count(DISTINCT s) AS n_links FROM p WHERE NOT same GROUP BY a)
SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN k USING (doc_id)
"""

OP2_SQL = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical_id,
       doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate
FROM documents
"""

OP6_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
k AS (SELECT *, trim(s) = '' OR row_number() OVER (PARTITION BY trim(s) ORDER BY doc_id, line) = 1 AS keep FROM l)
SELECT doc_id, coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (WHERE keep), '') AS text,
       count(*)::INTEGER AS n_lines, (count(*) FILTER (WHERE NOT keep))::INTEGER AS n_removed
FROM k GROUP BY doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_dedup, op3_toxicity, op4_pii, op5_packing, op6_line_dedup, op7_secret_scan, op8_permutation_ann, op9_source_mixing, op10_quality)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op6_line_dedup": OP6_SQL}
