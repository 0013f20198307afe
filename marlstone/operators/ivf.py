"""Approximate nearest neighbours by inverted lists: vectors lie with their nearest centroid, and a
query looks into the lists of its ``probes`` nearest ones.  Results are approximate and say so."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import BLOCK_VECTORS, STEP, _block_best, top_k

#: Vectors, the first by a hash of their id, that centroids are fitted on; every vector is indexed.
SAMPLE = 20_000
ROUNDS = 10


def centroids(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centroids by spherical k-means, begun with vectors spread over the sample."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.linalg.norm(total, axis=1)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


class IvfIndex:
    """``rows`` (list, part, chunk_id, vec), in one folder for each list."""

    def __init__(self, rows: DataFrame, parts: dict[int, int], c: np.ndarray):
        self.rows, self.parts, self.c = rows, parts, c

    @staticmethod
    def build(vectors: DataFrame, path: str, lists: int | None = None, block: int = BLOCK_VECTORS) -> "IvfIndex":
        """Index unit vectors (chunk_id, vec) under ``path``; null ones aren't found.  Lists of more than
        ``block`` vectors are searched in parts."""
        x = vectors.where("vec IS NOT NULL").select("chunk_id", "vec")
        some = x.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(SAMPLE).collect()
        if not some:
            raise ValueError("there are no vectors to index")
        c = centroids(np.array([r.vec for r in some]), lists or max(1, min(4096, math.ceil(math.sqrt(x.count())))))
        b_c = vectors.sparkSession.sparkContext.broadcast(c)

        def near(batches):
            for b in batches:
                v = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.argmax(v @ b_c.value.T, axis=1).astype(np.int32))], names=["chunk_id", "vec", "list"])

        kind = x.schema["chunk_id"].dataType.simpleString()
        placed = x.mapInArrow(near, f"chunk_id {kind}, vec array<double>, list int")
        placed.repartition("list").write.partitionBy("list").parquet(path)
        rows = vectors.sparkSession.read.schema(placed.schema).parquet(path)
        counts = {r.list: r["count"] for r in rows.groupBy("list").count().collect()}  # at most as many as lists
        return IvfIndex(rows, {k: math.ceil(n / block) for k, n in counts.items()}, c)

    def search(self, queries: DataFrame, k: int, probes: int = 8, digits: int = 12) -> DataFrame:
        """(query_id, chunk_id, relevance, rank, approximate) for queries (query_id, qvec)."""
        if k <= 0 or probes <= 0:
            raise ValueError("k and probes must be positive")
        c, parts = self.c, self.parts

        def visits(batches):
            for b in batches:
                q = np.array(b.column(1).to_pylist(), np.float64).reshape(b.num_rows, -1)
                order = np.argsort(-(q @ c.T), axis=1, kind="stable")
                to = [[f"{i}:{p}" for i in row[:probes].tolist() for p in range(parts.get(i, 0))] for row in order]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(to, pa.list_(pa.string()))], names=["query_id", "qvec", "cells"])

        kinds = [d.schema[n].dataType.simpleString() for d, n in ((queries, "query_id"), (self.rows, "chunk_id"))]
        q = queries.where("qvec IS NOT NULL").select("query_id", "qvec").mapInArrow(visits, f"query_id {kinds[0]}, qvec array<double>, cells array<string>")
        q = q.select("query_id", "qvec", F.explode("cells").alias("cell"))
        size = F.create_map(*[F.lit(v) for kv in self.parts.items() for v in kv])
        x = self.rows.withColumn("cell", F.concat_ws(":", "list", F.pmod(F.xxhash64("chunk_id"), size[F.col("list")])))
        best = _block_best(k, digits, STEP)
        out = x.select("chunk_id", "vec", "cell").groupBy("cell").cogroup(q.groupBy("cell")).applyInPandas(lambda key, a, b: best(key, a, b) if len(a) and len(b) else pd.DataFrame({"query_id": [], "chunk_id": [], "relevance": []}), f"query_id {kinds[0]}, chunk_id {kinds[1]}, relevance double")
        return top_k(out, k).withColumn("approximate", F.lit(True))
