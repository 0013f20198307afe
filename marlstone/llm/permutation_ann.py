"""k nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots, cut to a prefix.  It is posted in the
file of its leading pivots: files lie sorted in a written table, and where the first pivot alone
would make them too large the second one divides them.  A query visits the files whose pivots are
among its own nearest, ranks what it finds by the footrule distance of the permutation prefixes
and reranks by cosine whatever lies within ``cutoff``.  How far either goes is not guessed: the
exact neighbours of a bounded sample of vectors, found over all vectors, say how far it must for
the target recall.  On clustered vectors that is a small part of the index; on vectors without
structure it honestly becomes most of it.  No count of candidates is cut.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

NEIGHBOURS = 10
#: Vectors of a file that one group holds; larger files are cut, every query visits all parts.
BLOCK = 4096
CALIBRATION, TARGET = 256, 0.97
MOST_PIVOTS, FILE_VECTORS = 1024, 1024
STEP = 512
EVERY = 100


def permutations(v: np.ndarray, pivots: np.ndarray, prefix: int | None = None) -> np.ndarray:
    """Indices of the ``prefix`` nearest pivots (all by default), nearest first; equal distances
    in pivot order."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.int16)


def weights(perm: np.ndarray, m: int, prefix: int) -> np.ndarray:
    """prefix - place for the pivots of the prefix, 0 for the others.

    The footrule distance of two prefixes is a constant less twice the sum over pivots of the
    smaller of two weights.
    """
    w = np.zeros((len(perm), m), np.int16)
    np.put_along_axis(w, perm[:, :prefix].astype(np.int64), np.arange(prefix, 0, -1, dtype=np.int16)[None, :].repeat(len(perm), 0), 1)
    return w


class Inverted:
    """Pivot inverted files of a block: for each pivot the vectors that have it in their prefix,
    with their weights."""

    def __init__(self, perm: np.ndarray, m: int, prefix: int):
        n, prefix = len(perm), min(prefix, perm.shape[1])
        pivot = perm[:, :prefix].astype(np.int64).reshape(-1)
        by = np.argsort(pivot, kind="stable")
        self.n, self.prefix = n, prefix
        self.row = np.repeat(np.arange(n, dtype=np.int32), prefix)[by]
        self.weight = np.tile(np.arange(prefix, 0, -1, dtype=np.int16), n)[by]
        self.at = np.searchsorted(pivot[by], np.arange(m + 1))

    def overlap(self, perm: np.ndarray) -> np.ndarray:
        """Sum over the query's pivots of the smaller weight, for every vector of the block."""
        out = np.zeros(self.n, np.int32)
        for place, p in enumerate(perm[: self.prefix].tolist()):
            lo, hi = self.at[p], self.at[p + 1]
            if hi > lo:
                out[self.row[lo:hi]] += np.minimum(self.weight[lo:hi], self.prefix - place)
        return out


def _best(ids: np.ndarray, sims: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest, ties by id."""
    if len(ids) > 4 * k:
        cut = -np.partition(-sims, k - 1)[k - 1]
        at = np.flatnonzero(sims >= cut)
        return at[np.lexsort((ids[at], -sims[at]))][:k]
    return np.lexsort((ids, -sims))[:k]


_HITS = pa.schema([("vec_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("sims", pa.list_(pa.float64()))])


def _search(pivots_b, prefix: int, cutoff: int, k: int):
    """Rows in the order file, part, vectors before queries: one part is held, queries stream by."""

    def run(batches):
        pivots, dim = pivots_b.value, pivots_b.value.shape[1]
        held, ids, vecs, lists = None, [], [], None
        for b in batches:
            key = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            query = np.array(b.column(2).to_pylist(), bool)
            rid = b.column(3).to_numpy()
            raw = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(-1, dim)
            out = []
            cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1] or query[i] != query[i - 1]), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if key[lo] != held:
                    held, ids, vecs, lists = key[lo], [], [], None
                if not query[lo]:
                    ids.append(rid[lo:hi])
                    vecs.append(raw[lo:hi])
                    continue
                if not ids:
                    continue
                if lists is None:
                    x_id, x = np.concatenate(ids), np.concatenate(vecs)
                    ids, vecs = [x_id], [x]
                    lists = Inverted(permutations(x, pivots, prefix), len(pivots), prefix)
                x_id, x = ids[0], vecs[0]
                perm = permutations(raw[lo:hi], pivots, prefix)
                for i in range(hi - lo):
                    q = raw[lo + i]
                    at = np.flatnonzero((lists.overlap(perm[i]) >= cutoff) & (x_id != rid[lo + i]))
                    if len(at):
                        best = at[_best(x_id[at], x[at] @ q, k)]
                        # cosines of the few that may be returned, in full precision
                        out.append({"vec_id": int(rid[lo + i]), "ids": x_id[best].tolist(), "sims": (x[best].astype(np.float64) @ q.astype(np.float64)).tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, _HITS)

    return run


def _exact(sample_b, k: int):
    """The sample's best neighbours within each batch, with their vectors."""

    def run(batches):
        q_id, q = sample_b.value
        for b in batches:
            x_id = b.column(0).to_numpy()
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(len(x_id), -1)
            s = np.where(q_id[:, None] == x_id[None, :], -9.0, q @ x.T)
            rows = [(int(q_id[i]), int(x_id[j]), float(s[i, j]), x[j].tobytes()) for i in range(len(q_id)) for j in _best(x_id, s[i], k) if s[i, j] > -9]
            yield pa.RecordBatch.from_pylist([{"q": a, "vec_id": c, "sim": d, "v": e} for a, c, d, e in rows], pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("sim", pa.float64()), ("v", pa.binary())]))

    return run


def _unit(dim: int):
    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if v is None or len(v) != dim or any(x is None for x in v):
                    continue
                v = np.asarray(v, np.float64)
                n = math.sqrt(float(v @ v))
                if n > 0 and math.isfinite(n):
                    ids.append(i)
                    out.append((v / n).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], names=["vec_id", "v"])

    return run


def _post(pivots_b, groups: int):
    """The file of each vector: its first pivot and the group of its second."""

    def run(batches):
        m = len(pivots_b.value)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)
            perm = permutations(x, pivots_b.value, 2).astype(np.int64)
            file = perm[:, 0] * groups + perm[:, -1] * groups // m
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(file.astype(np.int32))], names=["vec_id", "v", "file"])

    return run


def _visit(pivots_b, groups: int, reach: int, second: int):
    """The files that each query visits, in no order."""

    def run(batches):
        m = len(pivots_b.value)
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float32).reshape(b.num_rows, -1)
            perm = permutations(x, pivots_b.value, max(reach, second)).astype(np.int64)
            one = perm[:, :reach] * groups
            two = perm[:, :second] * groups // m if groups > 1 else np.zeros((len(perm), 1), np.int64)
            files = [np.unique(a[:, None] + c[None, :]).astype(np.int32) for a, c in zip(one, two)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(files, pa.list_(pa.int32()))], names=["vec_id", "v", "files"])

    return run


class PermutationIndex:
    """``postings`` (file, part, vec_id, v), written in file order, and what a search needs."""

    def __init__(self, spark: SparkSession, pivots: np.ndarray, postings: DataFrame, parts: DataFrame, groups: int, reach: int, second: int, cutoff: int, prefix: int):
        self.spark, self.pivots, self.postings, self.parts = spark, pivots, postings, parts
        self.groups, self.reach, self.second, self.cutoff, self.prefix = groups, reach, second, cutoff, prefix

    @staticmethod
    def build(unit: DataFrame, n: int, k: int = NEIGHBOURS, target: float = TARGET, block: int = BLOCK) -> "PermutationIndex":
        """Index every row of ``unit`` (vec_id, v), n >= 2 in number; pivots and calibration queries
        are a bounded sample, the first by a hash of vec_id."""
        spark = unit.sparkSession
        m = int(min(n, max(32, min(MOST_PIVOTS, math.ceil(math.sqrt(n) / 2)))))
        groups = int(np.clip(n // (m * FILE_VECTORS), 1, m)) if m == MOST_PIVOTS else 1
        prefix = max(2, min(24, m // 3))
        head = unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(m + CALIBRATION).collect()
        as_array = lambda rows: np.stack([np.frombuffer(r.v, np.float32) for r in rows])
        pivots = as_array(head[:m])
        sample = head[m:] or head
        q_id, q = np.array([r.vec_id for r in sample]), as_array(sample)
        sc = spark.sparkContext
        pivots_b, sample_b = sc.broadcast(pivots), sc.broadcast((q_id, q))
        found = unit.mapInArrow(_exact(sample_b, k), "q long, vec_id long, sim double, v binary")
        best = F.slice(F.sort_array(F.collect_list(F.struct("sim", "vec_id", "v")), asc=False), 1, k)
        # k per query of each batch, then of each thread of a few, then of all: no list grows with the table
        near = found.withColumn("thread", F.pmod(F.xxhash64("vec_id"), F.lit(64))).groupBy("q", "thread").agg(best.alias("t"))
        near = near.select("q", F.explode("t").alias("t")).select("q", "t.*").groupBy("q").agg(best.alias("t")).collect()
        at = {int(i): j for j, i in enumerate(q_id)}
        perm_q = permutations(q, pivots)
        w_q = weights(perm_q, m, prefix)
        place, place2, score = [], [], []
        for r in near:
            j = at[r.q]
            t = permutations(as_array(r.t), pivots)
            inverse = np.argsort(perm_q[j])
            place += inverse[t[:, 0]].tolist()
            if groups > 1:
                of = np.full(groups, m)  # the nearest pivot of each group
                np.minimum.at(of, np.arange(m) * groups // m, inverse)
                place2 += of[t[:, 1].astype(np.int64) * groups // m].tolist()
            score += np.minimum(w_q[j][None, :], weights(t, m, prefix)).sum(1).tolist()
        miss = (1 - target) / (3 if groups > 1 else 2)  # each bound may lose its share of what may be lost
        reach = min(m, int(np.quantile(place, 1 - miss, method="higher")) + 1)
        second = min(m, int(np.quantile(place2, 1 - miss, method="higher")) + 1) if groups > 1 else 1
        cutoff = int(np.quantile(score, miss, method="lower"))
        posted = C.table(unit.mapInArrow(_post(pivots_b, groups), "vec_id long, v binary, file int"), "ann-posted")
        parts = C.table(posted.groupBy("file").agg(F.ceil(F.count("*") / block).cast("int").alias("parts")), "ann-files")
        part = F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part")
        placed = posted.join(C.small(parts, m * groups, 8), "file").select("file", part, "vec_id", "v")
        postings = C.table(placed.repartitionByRange("file", "part").sortWithinPartitions("file", "part"), "ann-postings")
        return PermutationIndex(spark, pivots, postings, parts, groups, reach, second, cutoff, prefix)

    def search(self, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
        """(vec_id, neighbour_id, rank, cosine) for every row of ``queries`` (vec_id, v)."""
        pivots_b = self.spark.sparkContext.broadcast(self.pivots)
        to = queries.mapInArrow(_visit(pivots_b, self.groups, self.reach, self.second), "vec_id long, v binary, files array<int>")
        to = to.select("vec_id", "v", F.explode("files").alias("file")).join(C.small(self.parts, len(self.pivots) * self.groups, 8), "file")
        to = to.select("file", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("query"), "vec_id", "v")
        both = self.postings.select("file", "part", F.lit(False).alias("query"), "vec_id", "v").unionByName(to)
        near = both.repartition("file", "part").sortWithinPartitions("file", "part", "query", "vec_id")
        hits = near.mapInArrow(_search(pivots_b, self.prefix, self.cutoff, k), "vec_id long, ids array<long>, sims array<double>")
        pairs = hits.select("vec_id", F.explode(F.arrays_zip("sims", "ids")).alias("z")).select("vec_id", (-F.col("z.sims")).alias("far"), F.col("z.ids").alias("id"), F.pmod(F.xxhash64("z.ids"), F.lit(16)).alias("thread"))
        best = F.slice(F.sort_array(F.collect_list(F.struct("far", "id"))), 1, k)
        some = pairs.groupBy("vec_id", "thread").agg(best.alias("b")).select("vec_id", F.explode("b").alias("b")).select("vec_id", "b.far", "b.id")
        out = some.groupBy("vec_id").agg(best.alias("best")).select("vec_id", F.posexplode("best").alias("pos", "b"))
        return out.select("vec_id", F.col("b.id").alias("neighbour_id"), (F.col("pos") + 1).alias("rank"), (-F.col("b.far")).alias("cosine"))


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, target: float = TARGET, block: int = BLOCK, every: int = EVERY) -> DataFrame:
    """(vec_id, neighbour_id, rank, cosine): the k nearest others, by cosine and among all rows, of
    every vector whose id is divisible by ``every``.

    Approximate with a recall calibrated to ``target``; ties by neighbour_id.  Vectors that are
    null, all zero, not finite, hold a null or aren't of the table's most frequent length (the
    largest of several) are neither queries nor neighbours, as are null ids.  Of rows that repeat
    an id the least vector counts; equal vectors under several ids are neighbours of each other.
    Fewer than k others give fewer rows; an empty table, or one without such ids, none.  Further
    columns are ignored.
    """
    spark = vectors.sparkSession
    raw = C.require(vectors, "vec_id", "embedding").where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    dims = raw.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "vec_id long, neighbour_id long, rank int, cosine double")
    if not dims or not dims[0].d:
        return empty
    unit = raw.mapInArrow(_unit(dims[0].d), "vec_id long, v binary")
    unit = C.table(unit.groupBy("vec_id").agg(F.min("v").alias("v")), "ann-vectors")
    n = unit.count()
    if n < 2:
        return empty
    return PermutationIndex.build(unit, n, k, target, block).search(unit.where(F.col("vec_id") % every == 0), k)
