"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The quota of each source, an exact number of blocks, is split recursively among the output
shards: a node that serves m shards hands its left half a draw without replacement from its
quotas, the right half gets the rest.  Every node's generator is seeded by the node alone, so
any task rebuilds the part of the tree that its documents need, and no other.  A shard's share of
a source is then a range of that source's pseudo-random permutation, disjoint from all others',
and the shard is shuffled locally.  The last block of a source may be partial: a quota is met to
the document, whatever the block size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

#: Exponent of the default target weights, count ** TEMPER.
TEMPER = 0.7
SHARD_DOCS = 2000
BUCKET_DOCS = 4096
SEED = 20
#: numpy's exact draw takes populations below 10^9; blocks are longer than one document only to
#: stay under this.
MOST_BLOCKS = 10**8
#: Weights and quotas are held by source on the driver and in every task.
MOST_SOURCES = 100_000
#: Nodes of the tree that a task remembers.
NODES = 20_000


class SplitTree:
    """Shares of every shard, as ranges of each source's permutation, in blocks."""

    def __init__(self, quotas: np.ndarray, shards: int, seed: int = SEED):
        self.quotas, self.shards, self.seed = np.asarray(quotas, np.int64), shards, seed
        self._left: dict[tuple[int, int], np.ndarray] = {}

    def split(self, quota: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Left and right quotas of the node that serves shards lo .. hi-1."""
        mid = (lo + hi) // 2
        rng = np.random.default_rng([self.seed, lo, hi])
        take = int(quota.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(quota, take, method="marginals")
        return left, quota - left

    def leaves(self) -> np.ndarray:
        """(shards, sources): blocks of each source in each shard.  The whole tree, for tests."""
        out = np.zeros((self.shards, len(self.quotas)), np.int64)
        todo = [(self.quotas, 0, self.shards)]
        while todo:
            quota, lo, hi = todo.pop()
            if hi - lo == 1:
                out[lo] = quota
                continue
            left, right = self.split(quota, lo, hi)
            mid = (lo + hi) // 2
            todo += [(left, lo, mid), (right, mid, hi)]
        return out

    def shards_of(self, source: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The shard of each (source, block of its permutation); only nodes on the way to one of
        them are drawn."""
        out = np.zeros(len(source), np.int32)
        todo = [(self.quotas, np.zeros(len(self.quotas), np.int64), 0, self.shards, np.arange(len(source)))]
        while todo:
            quota, start, lo, hi, rows = todo.pop()
            if hi - lo == 1:
                out[rows] = lo
                continue
            left = self._left.get((lo, hi))
            if left is None:
                left = self.split(quota, lo, hi)[0]
                if len(self._left) >= NODES:
                    self._left.clear()
                self._left[lo, hi] = left
            mid, s = (lo + hi) // 2, source[rows]
            go = block[rows] < (start + left)[s]
            if go.any():
                todo.append((left, start, lo, mid, rows[go]))
            if not go.all():
                todo.append((quota - left, start + left, mid, hi, rows[~go]))
        return out


def _level(counts: dict[str, int], w: dict[str, float], total: int) -> dict[str, float]:
    """Shares of ``total`` by weight, none above its source's supply (water-filling)."""
    out, left, mass = {}, float(total), sum(w.values())
    for s in sorted(w, key=lambda s: (counts[s] / w[s], s)):  # the first to run dry come first
        out[s] = min(float(counts[s]), left * w[s] / mass)
        left, mass = left - out[s], mass - w[s]
    return out


def quotas(counts: dict[str, int], weights: dict[str, float] | None = None, total: int | None = None) -> dict[str, int]:
    """Exact numbers of documents by source.

    Without ``weights``: count ** TEMPER, and without ``total`` as many documents as the sources
    can supply of their shares of the whole corpus, so that a small source is taken whole and
    takes nothing from the others.  A given ``total`` is filled as far as the supply goes: a
    source that runs dry leaves its share to the others, by weight.  ``weights`` without
    ``total`` are proportions to be met exactly, at the largest total that allows it.  Largest
    remainders make the quotas add up; a source without weight gets none.
    """
    w = {s: (c**TEMPER if weights is None else float(weights.get(s, 0.0))) for s, c in counts.items() if c}
    w = {s: x for s, x in w.items() if x > 0}
    mass = sum(w.values())
    if not w:
        return {}
    supply = sum(counts[s] for s in w)
    if total is not None:
        total = min(total, supply)
    elif weights is None:
        total = int(sum(min(counts[s], supply * x / mass) for s, x in w.items()) + 1e-6)
    else:
        total = int(min(counts[s] * mass / x for s, x in w.items()) + 1e-9)
    exact = _level(counts, w, total)
    out = {s: min(counts[s], int(e + 1e-9)) for s, e in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s)):
        if sum(out.values()) >= total:
            break
        if out[s] < counts[s]:
            out[s] += 1
    return out


def _shard_of(sources: list[str], quota: np.ndarray, block: int, shards: int, seed: int):
    @C.lean
    def run(batches):
        tree = SplitTree(-(-quota // block), shards, seed)
        at = {s: i for i, s in enumerate(sources)}
        for b in batches:
            rank = b.column(2).to_numpy()
            src = np.array([at.get(s, -1) for s in b.column(1).to_pylist()], np.int64)
            rows = np.flatnonzero((src >= 0) & (rank < quota[src]))
            shard = tree.shards_of(src[rows], rank[rows] // block)
            b = b.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shard)], names=["doc_id", "source", "shard"])

    return run


def mix(docs: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, shard_docs: int = SHARD_DOCS, seed: int = SEED, block: int | None = None) -> DataFrame:
    """(doc_id, source, shard, position) of the documents drawn.

    Each source supplies exactly its quota (see :func:`quotas`, over counts of all documents); the
    draw is without replacement and the same in every run.  Ties in the pseudo-random order go by
    doc_id.  A null source is the source ''.  Rows that repeat (doc_id, source) are one document; a
    doc_id under two sources is one in each.  Rows with a null doc_id are left out; text, however
    long, empty or null, plays no part.  Other columns are ignored; an empty table gives an empty
    result; more than MOST_SOURCES sources are an error.
    """
    spark = docs.sparkSession
    src = C.require(docs, "doc_id", "source").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    src = C.table(src.withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id")), "mix-docs")
    by_source = src.groupBy("source").count().limit(MOST_SOURCES + 1).collect()
    if len(by_source) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources: group them first")
    counts = {r.source: r["count"] for r in by_source}
    quota = quotas(counts, weights, total)
    n = sum(quota.values())
    if not n:
        return spark.createDataFrame([], "doc_id long, source string, shard int, position int")
    block = block or 1 + n // MOST_BLOCKS
    names = sorted(quota)
    shards = max(1, math.ceil(n / shard_docs))
    bits = max(0, math.ceil(math.log2(max(counts.values()) / BUCKET_DOCS + 1)))
    bucket = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
    src = src.withColumn("bucket", bucket)
    sizes = src.groupBy("source", "bucket").count()
    before = sizes.select("source", "bucket", (F.sum("count").over(W.partitionBy("source").orderBy("bucket")) - F.col("count")).alias("before"))
    n_buckets = len(counts) << bits
    inside = F.row_number().over(W.partitionBy("source", "bucket").orderBy(F.shiftleft("h", bits) if bits else F.col("h"), "doc_id")) - 1
    ranked = src.withColumn("inside", inside).join(C.small(before, n_buckets, 40), ["source", "bucket"]).select("doc_id", "source", (F.col("before") + F.col("inside")).alias("rank"))
    placed = ranked.mapInArrow(_shard_of(names, np.array([quota[s] for s in names], np.int64), block, shards, seed), "doc_id long, source string, shard int")
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "doc_id"), "doc_id", "source")
    return placed.withColumn("position", F.row_number().over(order))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The drawn rows of ``docs``, all columns as they are, laid out by shard and position.

    As :func:`mix` has it: rows that repeat (doc_id, source) are one document, and all of them come
    if it is drawn; rows with a null doc_id are left out; an empty table stays so.
    """
    to = {c: C.unused(docs, f"_mix_{c}") for c in ("doc_id", "source", "shard", "position")}
    drawn = C.table(mix(docs, **kw).select(*[F.col(c).alias(n) for c, n in to.items()]), "mix-drawn")
    on = (docs["doc_id"] == F.col(to["doc_id"])) & (F.coalesce(docs["source"].cast("string"), F.lit("")) == F.col(to["source"]))
    out = docs.join(C.small(drawn, drawn.count(), 48), on)
    out = out.repartition(to["shard"]).sortWithinPartitions(to["shard"], to["position"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
