"""Fitting on a bounded sample of labelled documents, inside one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, columns: list[str]) -> DataFrame:
    """At most ``rows`` labelled documents, the first by a hash of doc_id, with ``label`` last.

    A label of null is no label; of several labels for a document the largest counts.
    """
    lab = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_lab_id"), F.col("label").alias("_label"))
    return C.require(docs, "doc_id", *columns).join(F.broadcast(lab), F.col("doc_id") == F.col("_lab_id")).select("doc_id", *columns, F.col("_label").alias("label"))


def fit(rows: DataFrame, train: Callable[[list, list], bytes]) -> bytes | None:
    """``train(rows, labels)`` in one task over the whole sample; only the model comes back.

    Rows are put in the order of doc_id's hash, so that the model doesn't depend on partitioning.
    None if the sample is empty or has one label only.
    """
    import pyarrow as pa

    @C.lean
    def run(batches):
        got = [r for b in batches for r in b.to_pylist()]
        if len({r["label"] for r in got}) < 2:
            return
        got.sort(key=lambda r: (C.mix(np.array([r["doc_id"]], np.int64).view(np.uint64))[0], r["doc_id"], str(r.get("text"))))
        yield pa.RecordBatch.from_arrays([pa.array([train(got, [r["label"] for r in got])], pa.binary())], names=["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return bytes(found[0].model) if found else None
