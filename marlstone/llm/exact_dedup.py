"""Exact document deduplication over an extendible-hash index on shared files.

The directory maps the leading bits of a 64-bit key to buckets.  A bucket over ``capacity``
splits on its next bit, and the directory doubles when that bucket already used all of its bits;
a bucket is a contiguous range of keys and the owner of its entries.  Only texts whose key occurs
more than once are moved, equal ones once from each task that reads them, so that a text which a
third of all documents share costs an owner one row a task.  The owner of a key range gets its
texts in (key, doc_id) order, chains the different texts of one key and compares their bytes.

The index lies in the shared folder: the directory as a table, and the entries in one folder for
each owner.  It takes further batches: a batch reads and rewrites the folders of the owners that
its keys fall to, and no other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 50_000
#: Owners, and so folders; beyond this many buckets' worth of keys their capacity grows.
MOST_OWNERS = 16_384
#: Bound of the directory on the driver: 2^20 entries of 4 bytes.
MAX_DEPTH = 20
#: Text that a task holds while it looks for equal ones.
HELD_BYTES = 32 << 20


class Directory:
    """Extendible-hash directory: ``bucket[prefix]`` at ``depth`` leading key bits."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.depth = capacity, 0
        self.bucket = np.zeros(1, np.int32)
        self.local = [0]
        self.first = [0]

    def copy(self) -> "Directory":
        d = Directory(self.capacity)
        d.depth, d.bucket, d.local, d.first = self.depth, self.bucket.copy(), list(self.local), list(self.first)
        return d

    def _double(self) -> None:
        self.bucket = np.repeat(self.bucket, 2)
        self.depth += 1

    def fit(self, counts: np.ndarray, bits: int) -> None:
        """Split until no bucket exceeds the capacity; ``counts`` by the leading ``bits`` bits.

        Keys equal in all ``bits`` bits stay together and overflow in a chain.
        """
        total = np.concatenate([[0], np.cumsum(counts)])
        todo = list(range(len(self.local)))
        while todo:
            b = todo.pop()
            span = 1 << (bits - self.local[b])
            lo = self.first[b] << (bits - self.local[b])
            if self.local[b] >= bits or total[lo + span] - total[lo] <= self.capacity:
                continue
            if self.local[b] == self.depth:
                self._double()
            self.local[b] += 1
            self.first[b] *= 2
            self.local.append(self.local[b])
            self.first.append(self.first[b] + 1)
            new = len(self.local) - 1
            width = 1 << (self.depth - self.local[b])
            at = self.first[new] * width
            self.bucket[at : at + width] = new
            todo += [b, new]

    def table(self, spark: SparkSession) -> DataFrame:
        """(prefix, depth, bucket), a row for each directory entry, written."""
        rows = spark.createDataFrame(pa.table({"prefix": np.arange(len(self.bucket)), "depth": np.full(len(self.bucket), self.depth, np.int32), "bucket": self.bucket}))
        return C.table(rows.coalesce(1), "exact-directory")


def _owner(bucket_b, depth: int):
    """The owner of each key, the first column, as a further column."""

    def run(batches):
        for b in batches:
            key = b.column(0).to_numpy().view(np.uint64)
            prefix = (key >> np.uint64(64 - depth)).astype(np.int64) if depth else np.zeros(len(key), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket_b.value[prefix], pa.int32())], names=[*b.schema.names, "owner"])

    return run


def _owned(df: DataFrame, bucket_b, depth: int) -> DataFrame:
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(_owner(bucket_b, depth), f"{schema}, owner int")


def _combine(batches):
    """Of equal texts of one key that this task reads, the row of the least doc_id."""
    least: dict[tuple[int, bytes], int] = {}
    held = 0
    names = ["key", "doc_id", "text"]

    def flush():
        rows = list(least.items())
        for lo in range(0, len(rows), 1000):
            some = rows[lo : lo + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([k for (k, _), _ in some], pa.int64()), pa.array([d for _, d in some], pa.int64()), pa.array([t for (_, t), _ in some], pa.binary()).cast(pa.string())], names=names)

    for b in batches:
        for key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = text.as_buffer().to_pybytes()
            at = (key, raw)
            if at in least:
                least[at] = min(least[at], doc)
                continue
            least[at] = doc
            held += len(raw)
            if held > HELD_BYTES:
                yield from flush()
                least.clear()
                held = 0
    yield from flush()


def _compare(batches):
    """Rows in (key, doc_id) order: chain the different texts of a key and compare bytes."""
    last, chain = None, []
    for b in batches:
        ids, canon, at, keys = [], [], [], []
        for key, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            raw = text.as_buffer()
            if key != last:
                last, chain = key, []
            for k, (seen, first) in enumerate(chain):
                if raw.size == seen.size and raw.equals(seen):
                    break
            else:
                k, first = len(chain), doc
                chain.append((pa.py_buffer(raw.to_pybytes()), doc))
            ids.append(doc)
            canon.append(first)
            at.append(k)
            keys.append(key)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(canon, pa.int64()), pa.array(at, pa.int32())], names=["key", "doc_id", "canonical_id", "chain"])


def _keyed(docs: DataFrame) -> DataFrame:
    return C.require(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.xxhash64("text").alias("key"), F.col("doc_id").cast("long"), "text")


class ExactIndex:
    """The index of one corpus: ``entries`` (key, chain, canonical_id, owner), in one folder for each
    owner, ``rows`` (key, doc_id, canonical_id) and ``directory``, also as a written table."""

    def __init__(self, spark: SparkSession, directory: Directory, entries: DataFrame, rows: DataFrame):
        self.spark, self.directory, self.entries, self.rows = spark, directory, entries, rows
        self.table = directory.table(spark)

    @staticmethod
    def build(docs: DataFrame, capacity: int = CAPACITY) -> "ExactIndex":
        keys = C.table(_keyed(docs).select("key", "doc_id"), "exact-keys")
        directory = Directory(max(capacity, math.ceil(keys.count() / MOST_OWNERS)))
        ExactIndex._fit(keys, directory)
        entries, rows = ExactIndex._place(_keyed(docs), keys, directory)
        return ExactIndex(docs.sparkSession, directory, entries, rows)

    @staticmethod
    def _fit(every: DataFrame, directory: Directory) -> None:
        """Split the directory until it suits ``every`` key."""
        n = every.count()
        bits = int(np.clip(np.ceil(np.log2(max(n, 1) / directory.capacity + 1)) + 4, max(4, directory.depth), MAX_DEPTH))
        counts = np.zeros(1 << bits, np.int64)
        for r in every.groupBy(F.shiftrightunsigned("key", 64 - bits).alias("p")).count().collect():
            counts[r.p] = r["count"]
        directory.fit(counts, bits)

    @staticmethod
    def _place(src: DataFrame, keys: DataFrame, directory: Directory) -> tuple[DataFrame, DataFrame]:
        """Entries and rows of ``src``, whose keys are ``keys``."""
        spark = src.sparkSession
        bucket_b = spark.sparkContext.broadcast(directory.bucket)
        again = C.table(keys.groupBy("key").count().where("count > 1").select("key"), "exact-shared-keys")
        n_again = again.count()
        moved = src.join(C.small(again, n_again, 8), "key", "left_semi").select("key", "doc_id", "text").mapInArrow(_combine, "key long, doc_id long, text string")
        owned = _owned(moved, bucket_b, directory.depth)
        ranges = max(1, min(len(directory.local), 20_000))
        placed = owned.repartition(ranges, "owner").sortWithinPartitions("owner", "key", "doc_id").select("key", "doc_id", "text")
        chained = C.table(placed.mapInArrow(_compare, "key long, doc_id long, canonical_id long, chain int"), "exact-chains")
        firsts = chained.where("doc_id = canonical_id").select("key", "chain", "canonical_id").distinct()
        # a key of one text decides by itself; texts of colliding keys are compared once more
        several = C.table(firsts.where("chain > 0").select("key").distinct(), "exact-collisions")
        n_several = several.count()
        one = firsts.join(C.small(several, n_several, 8), "key", "left_anti").select("key", "canonical_id")
        rows = keys.join(C.small(again, n_again, 8), "key", "left_anti").select("key", "doc_id", F.col("doc_id").alias("canonical_id"), F.lit(0).alias("chain"))
        rows = rows.unionByName(keys.join(C.small(one, n_again, 16), "key").select("key", "doc_id", "canonical_id", F.lit(0).alias("chain")))
        if n_several:
            texts = src.join(C.small(several, n_several, 8), "key", "left_semi")
            heads = texts.join(firsts, "key").where("doc_id = canonical_id").select("key", "chain", "canonical_id", "text").distinct()
            rows = rows.unionByName(texts.join(heads, ["key", "text"]).select("key", "doc_id", "canonical_id", "chain"))
        rows = C.table(rows.distinct(), "exact-rows")
        entries = _owned(rows.where("doc_id = canonical_id").select("key", "chain", "canonical_id").distinct(), bucket_b, directory.depth)
        return C.table(entries.repartition("owner").sortWithinPartitions("owner", "key"), "exact-entries", by="owner"), rows

    def touched(self, keys: DataFrame) -> list[int]:
        """The owners to which ``keys`` fall."""
        bucket_b = self.spark.sparkContext.broadcast(self.directory.bucket)
        return sorted(r.owner for r in _owned(keys.select("key"), bucket_b, self.directory.depth).select("owner").distinct().collect())

    def probe(self, docs: DataFrame) -> DataFrame:
        """(doc_id, key, chain, canonical_id) of the entries that have a key of ``docs``; only the
        folders of the owners of those keys are read."""
        keys = C.table(_keyed(docs).select("key", "doc_id"), "exact-keys")
        return keys.join(self.entries.where(F.col("owner").isin(self.touched(keys))), "key").select("doc_id", "key", "chain", "canonical_id")

    def insert(self, docs: DataFrame, held: DataFrame) -> "ExactIndex":
        """Index ``docs`` as well; ``held`` are the documents indexed so far.  This index stays as it is.

        Overfull buckets split, the directory doubling where needed.  Bytes are compared within the
        keys that the batch shares with the index; owners that it doesn't fall to keep their folders.
        """
        new = C.table(_keyed(docs).select("key", "doc_id"), "exact-keys")
        directory = self.directory.copy()
        ExactIndex._fit(self.rows.select("key").unionByName(new.select("key")), directory)
        split = [b for b, d in enumerate(self.directory.local) if directory.local[b] != d]
        owners = sorted({*self.touched(new), *split})
        known = self.entries.where(F.col("owner").isin(owners))
        old_keys = C.table(known.select("key").distinct().join(new.select("key").distinct(), "key", "left_semi"), "exact-touched")
        n_old = old_keys.count()
        again = self.rows.join(C.small(old_keys, n_old, 8), "key", "left_semi").select("key", "doc_id")
        src = _keyed(docs).unionByName(_keyed(held).join(C.small(old_keys, n_old, 8), "key", "left_semi").select("key", "doc_id", "text"))
        entries, rows = ExactIndex._place(src, C.table(new.unionByName(again).distinct(), "exact-keys"), directory)
        bucket_b = self.spark.sparkContext.broadcast(directory.bucket)
        stay = _owned(known.join(C.small(old_keys, n_old, 8), "key", "left_anti").select("key", "chain", "canonical_id"), bucket_b, directory.depth)
        fresh = C.table(stay.unionByName(entries.select(stay.columns)).repartition("owner").sortWithinPartitions("owner", "key"), "exact-entries", by="owner")
        kept = self.entries.where(~F.col("owner").isin(owners)) if owners else self.entries
        rows = self.rows.join(C.small(old_keys, n_old, 8), "key", "left_anti").unionByName(rows)
        return ExactIndex(self.spark, directory, kept.unionByName(fresh.select(kept.columns)), C.table(rows, "exact-rows"))


def exact_dedup(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, canonical_id, is_duplicate) for every document.

    canonical_id is the smallest doc_id whose text has the same bytes; is_duplicate tells
    whether that is another document.  A null text equals no other: such a document is its own
    canonical.  Rows with a null doc_id are left out; an empty text is a text like any other, and
    so is a very long one, compared whole; equal rows give one result row, and a doc_id with
    several texts one per text.  Other columns are ignored; an empty table gives an empty result.
    """
    index = ExactIndex.build(docs, capacity)
    null = C.require(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NULL").select(F.col("doc_id").cast("long"), F.col("doc_id").cast("long").alias("canonical_id")).distinct()
    found = index.rows.select("doc_id", "canonical_id").unionByName(null)
    return found.withColumn("is_duplicate", F.col("doc_id") != F.col("canonical_id"))
