"""A persisted lexical index: postings by term, bound to a manifest, changed segment by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import with_tokens
from .store import Store


class SparseIndex:
    """``rows`` (term, chunk_id, tf, dl, digest): the terms of each chunk, and a row without term for
    every chunk, which tells its length and the digest of its text.

    Segments are sorted by term, so that a search reads the row groups of its terms only.  A search
    must bring the manifest that the index was made with.
    """

    def __init__(self, spark: SparkSession, path: str, manifest: dict):
        self.store, self.manifest = Store(spark, path), manifest

    def _rows(self, chunks: DataFrame) -> DataFrame:
        tok = with_tokens(chunks, "text", "terms", keep=("chunk_id", "text"))
        tok = tok.select("chunk_id", F.size("terms").alias("dl"), F.explode(F.concat(F.array(F.lit(None).cast("string")), "terms")).alias("term"), F.sha2("text", 256).alias("digest"))
        tok = tok.withColumn("digest", F.when(F.col("term").isNull(), F.col("digest")))
        rows = tok.groupBy("term", "chunk_id", "dl").agg(F.count("term").alias("tf"), F.max("digest").alias("digest"))
        return rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").select("term", "chunk_id", "tf", "dl", "digest")

    def upsert(self, chunks: DataFrame, strict: bool = False) -> None:
        """Index (chunk_id, text); an id that is there is replaced, or refused if ``strict`` and its text
        is another.  All or nothing."""
        if not chunks.groupBy("chunk_id").count().where("count > 1").isEmpty():
            raise ValueError("a batch holds an id twice")
        if strict and self.store.manifest() is not None:
            was = self.lengths().select("chunk_id", F.col("digest").alias("was"))
            if not chunks.join(was, "chunk_id").where(~F.sha2("text", 256).eqNullSafe(F.col("was"))).isEmpty():
                raise ValueError("an indexed id has other contents")
        self.store.replace(self._rows(chunks), chunks.select("chunk_id"), self.manifest)

    def delete(self, ids: DataFrame) -> None:
        self.store.delete(ids, self.manifest)

    def lengths(self) -> DataFrame:
        """(chunk_id, dl, digest) of every chunk."""
        return self.store.rows(self.manifest).where("term IS NULL").select("chunk_id", "dl", "digest")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, chunk_id, dl, tf), of the given terms only."""
        rows = self.store.rows(self.manifest).where("term IS NOT NULL")
        return (rows if terms is None else rows.where(F.col("term").isin(terms))).select("term", "chunk_id", "dl", "tf")
