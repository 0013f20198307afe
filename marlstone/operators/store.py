"""Index tables as segments of Parquet files behind numbered pointers.

A mutation writes one segment, the new rows and the ids that they replace or that are deleted, and
then a pointer with the next number, which lists the segments; a rename that fails if the number is
taken makes it visible at once and tells writers that come at the same time apart.  A reader takes
the highest number: it sees the state before a mutation or the state after it.  Nothing that was
written is rewritten until :meth:`Store.compact`; what no pointer needs stays until
:meth:`Store.vacuum`.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST_FIELDS = ("schema_version", "corpus", "chunker", "embedder", "dimension", "normalization", "domain_schema", "indexing")


class IncompatibleIndex(ValueError):
    pass


class MissingIndex(LookupError):
    pass


class ConcurrentChange(RuntimeError):
    pass


def manifest_differences(a: dict, b: dict) -> list[str]:
    return [f for f in MANIFEST_FIELDS if a.get(f) != b.get(f)]


def merged(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """New rows replace old ones of the same id."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def conflicts(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Ids that both sides hold with different contents."""
    digest = lambda d: d.select(key, F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(d.columns) if c != key])), 256).alias("h"))
    o, n = digest(old).withColumnRenamed("h", "o"), digest(new).withColumnRenamed("h", "n")
    return o.join(n, key).where("o <> n").select(key).distinct()


def without(old: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows whose id isn't deleted; ids that aren't there change nothing."""
    return old.join(ids.select(key).distinct(), key, "left_anti")


class Store:
    """One collection under ``path``, on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        at = self._path(self.path)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _read_pointer(self) -> dict | None:
        numbers = [n for n in self._names() if re.fullmatch(r"pointer-\d{10}", n)]
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/{max(numbers)}", wholetext=True).first().value)

    def _commit(self, before: dict | None, segments: list[str], manifest: dict) -> None:
        number = before["number"] + 1 if before else 0
        temporary = self._path(f"{self.path}/.pointer-{uuid.uuid4().hex}")
        out = self._fs.create(temporary, False)
        out.write(bytearray(json.dumps({"number": number, "segments": segments, "manifest": manifest}, sort_keys=True).encode()))
        out.close()
        to = self._path(f"{self.path}/pointer-{number:010d}")
        if self._fs.exists(to) or not self._fs.rename(temporary, to):
            self._fs.delete(temporary, False)
            raise ConcurrentChange("the index was changed meanwhile")

    def _segment(self, rows: DataFrame | None, gone: DataFrame | None) -> str:
        name = f"segment-{uuid.uuid4().hex}"
        if rows is not None:
            rows.write.parquet(f"{self.path}/{name}/rows")
        if gone is not None:
            gone.select("chunk_id").distinct().write.parquet(f"{self.path}/{name}/gone")
        return name

    def manifest(self) -> dict | None:
        p = self._read_pointer()
        return p and p["manifest"]

    def require(self, manifest: dict) -> dict:
        p = self._read_pointer()
        if p is None:
            raise MissingIndex("nothing has been indexed here")
        if diff := manifest_differences(p["manifest"], manifest):
            raise IncompatibleIndex("index and request differ in " + ", ".join(diff))
        return p

    def _has(self, segment: str, part: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{segment}/{part}"))

    def _rows(self, pointer: dict) -> DataFrame:
        """Rows of each segment without the ids that a later one names."""
        out, gone = None, None
        for name in reversed(pointer["segments"]):
            if self._has(name, "rows"):
                rows = self.spark.read.parquet(f"{self.path}/{name}/rows")
                rows = rows if gone is None else rows.join(gone, "chunk_id", "left_anti").select(rows.columns)
                out = rows if out is None else rows.unionByName(out)
            if self._has(name, "gone"):
                ids = self.spark.read.parquet(f"{self.path}/{name}/gone")
                gone = ids if gone is None else gone.union(ids)
        return out

    def rows(self, manifest: dict) -> DataFrame:
        return self._rows(self.require(manifest))

    def upsert(self, new: DataFrame, manifest: dict, strict: bool = False) -> None:
        """All or nothing.  Ids must be unique within ``new``; ``strict`` (the lexical index)
        refuses an id that is indexed with other contents, otherwise the new row replaces it."""
        if not new.groupBy("chunk_id").count().where("count > 1").isEmpty():
            raise ValueError("a batch holds an id twice")
        self.replace(new, new, manifest, strict)

    def replace(self, rows: DataFrame, ids: DataFrame, manifest: dict, strict: bool = False) -> None:
        """``rows``, any number of each id, take the place of what ``ids`` have."""
        p = self._read_pointer()
        if p is None:
            return self._commit(None, [self._segment(rows, None)], manifest)
        old = self._rows(self.require(manifest))
        if strict and not conflicts(old, rows).isEmpty():
            raise ValueError("an indexed id has other contents")
        self._commit(p, [*p["segments"], self._segment(rows, ids)], manifest)

    def delete(self, ids: DataFrame, manifest: dict) -> None:
        p = self.require(manifest)
        self._commit(p, [*p["segments"], self._segment(None, ids)], manifest)

    def compact(self, manifest: dict) -> None:
        """One segment in place of all; the rows stay the same."""
        p = self.require(manifest)
        self._commit(p, [self._segment(self._rows(p), None)], manifest)

    def search(self, queries: DataFrame, manifest: dict, k: int, where=None, metric: str = "dot") -> DataFrame:
        """Exact k nearest rows (chunk_id, vec, ...) of each query (query_id, qvec) that ``where`` admits."""
        from .retrieval import dense

        return dense(self.rows(manifest), queries, k, where, metric)

    def vacuum(self) -> None:
        """Drop the pointers before the last, and the segments that it doesn't name."""
        last = self._read_pointer() or {"number": -1, "segments": []}
        for name in self._names():
            old = name.startswith("pointer-") and name < f"pointer-{last['number']:010d}"
            if old or name.startswith(".pointer-") or (name.startswith("segment-") and name not in last["segments"]):
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
