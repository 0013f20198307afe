"""Reversible line deduplication: sharded cuckoo filters over exact reference-count tables.

A line is keyed by two 64-bit hashes of its trimmed text; the key's shard owns a cuckoo filter
and a part of two exact tables: the references (key, doc_id, first line, times) and, by key, how
many references there are.  A batch of documents is inserted by asking the filters first: keys
that they have never seen are new and go into filter and tables without a lookup; only keys that
they may have seen are looked up in the exact table.  A deletion takes references out and counts
down; a key whose last reference goes is deleted from its filter, so that the state is that of
never having inserted the document.  The reference with the smallest (doc_id, line) owns the
line; all others are repeats.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SLOTS, FINGERPRINT_BITS, LOAD, KICKS = 4, 16, 0.85, 500
#: Distinct lines of a shard when an index is begun; the number of shards follows the corpus.
SHARD_LINES = 200_000


class CuckooFilter:
    """Cuckoo filter (Fan et al. 2014): 16-bit fingerprints, four slots a bucket, deletions."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, math.ceil(math.log2(max(1, capacity) / SLOTS / LOAD)))
        self.slots = np.zeros((self.buckets, SLOTS), np.uint16)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        fp = (keys >> np.uint64(64 - FINGERPRINT_BITS)).astype(np.uint64)
        fp[fp == 0] = 1
        a = (C.mix(keys) & np.uint64(self.buckets - 1)).astype(np.int64)
        return fp.astype(np.uint16), a, self._other(a, fp)

    def _other(self, at: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return at ^ (C.mix(np.asarray(fp, np.uint64)) & np.uint64(self.buckets - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        fp, a, b = self._places(keys)
        return (self.slots[a] == fp[:, None]).any(1) | (self.slots[b] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Insert distinct keys; those that found no place come back, and leave no trace."""
        fp, a, b = self._places(keys)
        rest = np.arange(len(keys))
        for slot in range(SLOTS):  # the bulk goes in vectorised: one key a bucket and slot
            for place in (a, b):
                if not len(rest):
                    return keys[:0]
                free = rest[self.slots[place[rest], slot] == 0]
                _, first = np.unique(place[free], return_index=True)
                win = free[first]
                self.slots[place[win], slot] = fp[win]
                rest = np.setdiff1d(rest, win, assume_unique=True)
        rng, homeless = np.random.default_rng(len(keys)), []
        for i in rest.tolist():
            f, at, path = fp[i], int(a[i]), []
            for _ in range(KICKS):
                empty = np.flatnonzero(self.slots[at] == 0)
                if len(empty):
                    self.slots[at, empty[0]] = f
                    break
                s = int(rng.integers(SLOTS))
                path.append((at, s))
                f, self.slots[at, s] = self.slots[at, s], f
                at = int(self._other(np.array([at]), np.array([f]))[0])
            else:
                for at, s in reversed(path):
                    f, self.slots[at, s] = self.slots[at, s], f
                homeless.append(i)
        return keys[homeless]

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Delete keys; those of which there is no fingerprint come back."""
        fp, a, b = self._places(keys)
        missed = []
        for i, (f, x, y) in enumerate(zip(fp.tolist(), a.tolist(), b.tolist())):
            for at in (x, y):
                hit = np.flatnonzero(self.slots[at] == f)
                if len(hit):
                    self.slots[at, hit[0]] = 0
                    break
            else:
                missed.append(i)
        return keys[missed]


class GrowingFilter:
    """Cuckoo filters of doubling size: what the last one can't take goes into the next, so that
    insertions never need the keys that are in already."""

    def __init__(self, capacity: int = 1, tables: list[CuckooFilter] | None = None):
        self.tables = tables or [CuckooFilter(capacity)]

    def contains(self, keys: np.ndarray) -> np.ndarray:
        return np.logical_or.reduce([t.contains(keys) for t in self.tables])

    def insert(self, keys: np.ndarray) -> None:
        """Insert distinct keys that aren't in."""
        for t in self.tables:
            keys = t.insert(keys)
        while len(keys):
            self.tables.append(CuckooFilter(max(len(keys), self.tables[-1].buckets * SLOTS * 2)))
            keys = self.tables[-1].insert(keys)

    def delete(self, keys: np.ndarray) -> None:
        """Delete keys that are in."""
        for t in reversed(self.tables):
            keys = t.delete(keys)

    def blob(self) -> bytes:
        head = np.array([len(self.tables), *(t.buckets for t in self.tables)], np.int64)
        return head.tobytes() + b"".join(t.slots.tobytes() for t in self.tables)

    @staticmethod
    def load(blob: bytes) -> "GrowingFilter":
        n = int(np.frombuffer(blob, np.int64, 1)[0])
        tables, at = [], 8 * (n + 1)
        for buckets in np.frombuffer(blob, np.int64, n, 8).tolist():
            t = CuckooFilter.__new__(CuckooFilter)
            t.buckets, t.slots = buckets, np.frombuffer(blob, np.uint16, buckets * SLOTS, at).reshape(-1, SLOTS).copy()
            tables.append(t)
            at += 2 * buckets * SLOTS
        return GrowingFilter(tables=tables)


@C.lean
def _admit(key, held: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
    """The batch's keys of one shard: what the filter, as it was, says of each, and the filter with
    those that it had never seen."""
    h = lines["h1"].to_numpy(np.int64).view(np.uint64)
    f = GrowingFilter.load(held["filter"].iloc[0]) if len(held) else GrowingFilter(len(h))
    seen = f.contains(h) if len(held) else np.zeros(len(h), bool)
    f.insert(np.unique(h[~seen]))
    out = lines[["shard", "h1", "h2", "n"]].assign(maybe=seen, filter=None)
    out.loc[len(out)] = [int(key[0]), 0, 0, 0, False, f.blob()]
    return out


@C.lean
def _update(key, held: pd.DataFrame, change: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter after deletions (``live`` false) and insertions (``live`` true)."""
    f = GrowingFilter.load(held["filter"].iloc[0]) if len(held) else GrowingFilter()
    h, live = change["h1"].to_numpy(np.int64).view(np.uint64), change["live"].to_numpy(bool)
    f.delete(np.unique(h[~live]))
    f.insert(np.unique(h[live]))
    return pd.DataFrame({"shard": [int(key[0])], "filter": [f.blob()]})


def lines_of(docs: DataFrame) -> DataFrame:
    """References: (h1, h2, doc_id, line, times) with the first line of each key in a document."""
    src = C.require(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    line = src.select(F.col("doc_id").cast("long"), F.posexplode(F.split("text", "\n")).alias("line", "s")).withColumn("s", F.trim("s")).where("s <> ''")
    keyed = line.select(F.xxhash64("s").alias("h1"), F.xxhash64(F.lit(1), "s").alias("h2"), "doc_id", "line")
    return keyed.groupBy("h1", "h2", "doc_id").agg(F.min("line").alias("line"), F.count("*").alias("times"))


class LineIndex:
    """``refs``: the exact references; ``counts`` (shard, h1, h2, n): how many each key has;
    ``filters``: one filter a shard."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int):
        self.refs, self.counts, self.filters, self.shards = refs, counts, filters, shards

    @staticmethod
    def build(docs: DataFrame, shards: int | None = None) -> "LineIndex":
        """An index with ``docs`` as its first batch."""
        spark = docs.sparkSession
        refs = C.table(lines_of(docs), "line-refs")
        if shards is None:
            shards = max(4, math.ceil((refs.agg(F.approx_count_distinct("h1")).first()[0] or 0) / SHARD_LINES))
        empty = lambda schema: spark.createDataFrame([], schema)
        index = LineIndex(empty(refs.schema), empty("shard int, h1 long, h2 long, n long"), empty("shard int, filter binary"), shards)
        return index._insert(refs)

    def _shard(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod("h2", F.lit(self.shards)).cast("int"))

    def probe(self, lines: DataFrame) -> DataFrame:
        """(shard, h1, h2, n, maybe, filter) of the references ``lines``: a row for each key, with how
        many of them have it and whether an indexed one may; and a row for each shard, with what
        its filter is once the keys that no indexed one has are in."""
        keys = self._shard(lines.groupBy("h1", "h2").agg(F.count("*").alias("n")))
        asked = self.filters.groupBy("shard").cogroup(keys.groupBy("shard"))
        return C.table(asked.applyInPandas(_admit, "shard int, h1 long, h2 long, n long, maybe boolean, filter binary"), "line-probe")

    def insert(self, docs: DataFrame) -> "LineIndex":
        """Add documents that are not indexed yet (a doc_id that is, is ignored)."""
        new = lines_of(docs).join(self.refs.select("doc_id").distinct(), "doc_id", "left_anti").select("h1", "h2", "doc_id", "line", "times")
        return self._insert(C.table(new, "line-refs"))

    def _insert(self, lines: DataFrame) -> "LineIndex":
        asked = self.probe(lines)
        keys, filters = asked.where("filter IS NULL").drop("filter"), asked.where("filter IS NOT NULL").select("shard", "filter")
        maybe = keys.where("maybe").drop("maybe")
        n_maybe = maybe.count()
        counts = self.counts.unionByName(keys.where("NOT maybe").drop("maybe"))
        if n_maybe:  # only these are looked up
            known = self.counts.join(C.small(maybe.select("h1", "h2"), n_maybe, 16), ["h1", "h2"], "left_semi")
            # false positives that share their h1 with no indexed key go into the filter now
            wrong = maybe.join(known.select("h1").distinct(), "h1", "left_anti").select("shard", "h1", F.lit(True).alias("live")).distinct()
            wrong = C.table(wrong.select("shard", "h1", "live"), "line-wrong")
            filters = filters.groupBy("shard").cogroup(wrong.groupBy("shard")).applyInPandas(_update, "shard int, filter binary")
            counts = counts.unionByName(maybe).groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n"))
        return LineIndex(C.table(self.refs.unionByName(lines), "line-refs") if not self.refs.isEmpty() else lines, C.table(counts, "line-counts"), C.table(filters, "line-filters"), self.shards)

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """Take documents out; a second deletion of the same document changes nothing."""
        ids = C.table(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct(), "line-gone")
        n = ids.count()
        out = self.refs.join(C.small(ids, n, 8), "doc_id", "left_semi").groupBy("h1", "h2").agg((-F.count("*")).alias("n"))
        counts = C.table(self.counts.unionByName(self._shard(out).select("shard", "h1", "h2", "n")).groupBy("shard", "h1", "h2").agg(F.sum("n").alias("n")), "line-counts")
        gone = counts.where("n = 0").select("shard", "h1").distinct().join(counts.where("n > 0").select("h1").distinct(), "h1", "left_anti").select("shard", "h1", F.lit(False).alias("live"))
        filters = self.filters.groupBy("shard").cogroup(gone.groupBy("shard")).applyInPandas(_update, "shard int, filter binary")
        refs = self.refs.join(C.small(ids, n, 8), "doc_id", "left_anti").select(self.refs.columns)
        return LineIndex(C.table(refs, "line-refs"), C.table(counts.where("n > 0"), "line-counts"), C.table(filters, "line-filters"), self.shards)

    def repeats(self) -> DataFrame:
        """(doc_id, h1) of the references that don't own their line.  Keys of one reference, which
        the counts settle, aren't looked at."""
        some = self.counts.where("n > 1").select("h1", "h2")
        refs = C.table(self.refs.join(C.small(some, some.count(), 16), ["h1", "h2"]).select("h1", "h2", "doc_id"), "line-several")
        first = refs.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        n = some.count()
        return refs.join(C.small(first, n, 24), ["h1", "h2"]).where("doc_id <> owner").select("doc_id", "h1")


def dedup_lines(docs: DataFrame, index: LineIndex | None = None) -> DataFrame:
    """All columns of ``docs`` with the text stripped of repeated lines, and ``n_lines``,
    ``n_removed``.

    A non-blank line, trimmed of spaces, stays where its smallest (doc_id, line number) is; its
    other occurrences, in that document or others, are removed.  Blank lines stay.  A null text
    stays null with 0 lines; an empty text has one blank line; a very long text, or line, is
    treated whole like any other.  Rows with a null doc_id are returned as they are.  Rows that
    repeat a doc_id count as one document: a line that it doesn't own goes from all of them, one
    that it owns stays once in each.  Columns already named n_lines or n_removed are replaced.  An
    empty table stays so.  ``index``: one that has all of ``docs``.
    """
    index = index or LineIndex.build(docs)
    id_name, gone_name = C.unused(docs, "_gone_id"), C.unused(docs, "_gone")
    gone = index.repeats().groupBy(F.col("doc_id").alias(id_name)).agg(F.collect_set("h1").alias(gone_name))
    gone = C.table(gone, "line-drops")
    size = gone.agg(F.count("*"), F.sum(F.size(gone_name))).first()
    joined = docs.join(C.small(gone, size[0], 24 + 8 * (size[1] or 0) // max(1, size[0])), docs["doc_id"] == gone[id_name], "left")
    fields = [f for f in docs.schema if f.name.lower() not in ("n_lines", "n_removed")]
    names = [f.name for f in fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines int, n_removed int"
    return joined.select(*[docs[f"`{n}`"] for n in names], gone[gone_name]).mapInArrow(_strip(names.index("doc_id"), names.index("text")), schema)


def _key(s: str) -> int:
    """``xxhash64`` of the line as the JVM has it."""
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _strip(id_at: int, text_at: int):
    @C.lean
    def run(batches):
        for b in batches:
            text, lines, gone = [], [], []
            for doc, s, drop in zip(b.column(id_at).to_pylist(), C.each(b.column(text_at)), b.column(b.num_columns - 1).to_pylist()):
                if s is None:
                    text.append(None)
                    lines.append(0)
                    gone.append(0)
                    continue
                every = s.split("\n")
                keep = every
                if doc is not None and (drop or len(every) > 1):
                    drop, seen, keep = set(drop or ()), set(), []
                    for x in every:
                        line = x.strip(" ")
                        if line and (line in seen or (drop and _key(line) in drop)):
                            continue
                        seen.add(line)
                        keep.append(x)
                text.append("\n".join(keep) if len(keep) < len(every) else s)
                lines.append(len(every))
                gone.append(len(every) - len(keep))
            cols = list(b.columns[:-1])
            cols[text_at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int32()), pa.array(gone, pa.int32())], names=[*b.schema.names[:-1], "n_lines", "n_removed"])

    return run
