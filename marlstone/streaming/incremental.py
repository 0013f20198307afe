"""Incremental indexing: chunks that arrive as a stream become generations of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import Store


def index_stream(chunks: DataFrame, store: Store, manifest: dict, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Upsert every micro-batch as a segment; one that is replayed after a failure replaces its own rows.

    Of the rows of an id within a batch the one with the largest ``at`` counts, if there is such a
    column; of equal ones, or without it, the one whose hash is largest.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        row = F.struct(*[F.col(f"`{c}`") for c in batch.columns])
        last = F.max_by(row, F.struct("at", F.xxhash64(*batch.columns))) if "at" in batch.columns else F.max_by(row, F.xxhash64(*batch.columns))
        rows = batch.groupBy("chunk_id").agg(last.alias("row")).select("row.*").persist()
        if not rows.isEmpty():
            store.upsert(rows, manifest, strict)
        rows.unpersist()

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
