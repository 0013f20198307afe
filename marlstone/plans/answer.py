"""Files to cited answers: index a directory, ask a batch of questions, evaluate examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.spans import Policy
from ..functions.text import trim
from ..operators import answering as A
from ..operators import chunking as C
from ..operators import evaluation as E
from ..operators import extraction as X
from ..operators import retrieval as R
from ..operators.store import Store
from ..sources import files
from . import policy as P


def chunks_of(spark: SparkSession, profile: dict, uri: str | None = None) -> DataFrame:
    """(chunk_id, document_id, ordinal, text, uri, start, end, structural_path) of all text files."""
    uri = uri or profile["source"]["uri"]
    assets = files.scan_files(spark, uri, profile["source"]["max_files"], profile["source"]["max_bytes"])
    parts = X.extract_text(X.classify(assets)).withColumn("document_id", F.concat(F.lit("doc-"), F.sha2("uri", 256)))
    c = {k: v for k, v in profile["chunking"].items()}
    made = C.chunk_text(parts.select("document_id", "part_id", "ordinal", "text", "start"), Policy(**{**c, "strategy": C.resolve("text", Policy(**c)).strategy}))
    made = made.join(parts.select("document_id", "uri").distinct(), "document_id")
    key = P.manifest(uri, profile)["chunker"]
    return made.withColumn("chunk_id", ids.chunk_id_column(key, F.col("document_id"), F.col("part_id"), F.col("start"), F.col("end"), F.col("text"))).where(trim(F.col("text")) != "")


def index(spark: SparkSession, profile: dict, path: str, uri: str | None = None) -> int:
    """Write the chunks of the corpus to the store at ``path``; their number."""
    uri = uri or profile["source"]["uri"]
    store = Store(spark, path)
    store.upsert(chunks_of(spark, profile, uri), P.manifest(uri, profile))
    return store.rows(P.manifest(uri, profile)).count()


def retrieve(chunks: DataFrame, queries: DataFrame, profile: dict) -> DataFrame:
    """The top chunks of each query by the profile's strategy, with their text."""
    r, i = profile["retrieval"], profile["indexing"]
    text = chunks.select("chunk_id", "document_id", "uri", "text")
    if i["strategy"] in ("sparse", "hybrid"):
        n = r["top_k"] if i["strategy"] == "sparse" else R.depth(r["top_k"], r["candidate_multiplier"], r["max_candidates"])
        sparse = R.bm25(text, queries, n)
        if i["strategy"] == "sparse":
            return sparse.join(text, "chunk_id")
    n = r["top_k"] if i["strategy"] != "hybrid" else R.depth(r["top_k"], r["candidate_multiplier"], r["max_candidates"])
    q = R.hash_embeddings(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), i["dimension"]).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    near = R.dense(R.hash_embeddings(text, i["dimension"]), q, n)
    return (near if i["strategy"] != "hybrid" else R.rrf([sparse, near], r["top_k"], r["rrf_k"])).join(text, "chunk_id")


def ask(chunks: DataFrame, queries: DataFrame, profile: dict) -> tuple[DataFrame, DataFrame]:
    """(answers, retrieved) of a batch of questions."""
    g = profile["generation"]
    found = retrieve(chunks, queries, profile)
    inc = A.within_budget(found, g["max_context_chars"])
    return A.extractive_answers(inc, queries, g["max_output_tokens"], g["temperature"]), found


def evaluate(chunks: DataFrame, examples: DataFrame, profile: dict) -> DataFrame:
    """Metrics of examples (example_id, query, expected_answer)."""
    q = examples.select(F.col("example_id").alias("query_id"), "query")
    said, found = ask(chunks, q, profile)
    ex = examples.withColumn("relevant", F.array().cast("array<string>"))
    return E.answers_report(ex, found.withColumnRenamed("query_id", "example_id"), said.withColumnRenamed("query_id", "example_id"))
