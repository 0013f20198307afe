"""Inverted lists, service stores through clients of our own, hosted generation, provenance."""

import json
import sqlite3
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from marlstone.operators import answering as A
from marlstone.operators import filters as L
from marlstone.operators import retrieval as R
from marlstone.operators import services as V
from marlstone.operators.ivf import IvfIndex, centroids
from marlstone.operators.store import MANIFEST_FIELDS, IncompatibleIndex, MissingIndex


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests


def _unit(n, dim, seed, clusters=None):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dim)) + (0 if clusters is None else 4 * rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_inverted_lists(spark, tmp_path):
    v = _unit(600, 12, 0, 15)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "chunk_id long, vec array<double>")
    q = df.where("chunk_id % 10 = 0 AND vec IS NOT NULL").select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    index = IvfIndex.build(df, str(tmp_path / "ivf"), 20, block=16)
    assert max(index.parts.values()) > 1 and index.rows.count() == 600
    want = {(i, int(j)) for i in range(0, 600, 10) for j in np.argsort(-(v @ v[i]), kind="stable")[:5]}
    some = index.search(q, 5, probes=5).collect()
    assert len(want & {(r.query_id, r.chunk_id) for r in some}) >= 0.9 * len(want) and all(r.approximate for r in some)
    every = {(r.query_id, r.chunk_id) for r in index.search(q, 5, probes=20).collect()}
    assert every == want
    assert np.allclose(np.linalg.norm(centroids(v, 7), axis=1), 1)
    with pytest.raises(ValueError):
        IvfIndex.build(df.where("vec IS NULL"), str(tmp_path / "none"))


class Client:
    """A service in a file: records as JSON, exact search, filters by the meaning of the tree."""

    def __init__(self, path, backend):
        self.db, self.backend = sqlite3.connect(path, timeout=30), backend
        self.db.execute("CREATE TABLE IF NOT EXISTS r (id TEXT PRIMARY KEY, j TEXT)")

    def manifest(self):
        row = self.db.execute("SELECT j FROM r WHERE id = ?", (V.SENTINEL,)).fetchone()
        return row and json.loads(row[0])

    def _put(self, key, j):
        with self.db:
            self.db.execute("INSERT OR REPLACE INTO r VALUES (?, ?)", (key, json.dumps(j)))

    def bind(self, manifest):
        self._put(V.SENTINEL, manifest)

    def write(self, records):
        for r in records:
            self._put(r.get("id") or r["_id"], r)

    def remove(self, ids):
        with self.db:
            self.db.executemany("DELETE FROM r WHERE id = ?", [(i,) for i in ids])

    def search(self, vector, k, form):
        out = []
        for key, j in self.db.execute("SELECT id, j FROM r WHERE id <> ?", (V.SENTINEL,)):
            r = json.loads(j)
            vec = r.get("embedding") or r.get("vector") or r.get("values")
            s = float(np.dot(vec, vector))
            out.append((r["payload"]["chunk_id"] if self.backend == "qdrant" else key, 1 - s if self.backend == "pgvector" else s))
        return sorted(out, key=lambda x: x[1], reverse=self.backend != "pgvector")[:k]


@pytest.mark.parametrize("backend", V.BACKENDS)
def test_services(spark, tmp_path, backend):
    path, m = str(tmp_path / "s.db"), {f: 1 for f in MANIFEST_FIELDS}
    connect = lambda: Client(path, backend)
    store = V.ServiceStore(backend, connect, m)
    v = _unit(12, 4, 1)
    chunks = spark.createDataFrame([(f"c{i:02}", x.tolist(), f"text {i}", json.dumps({"n": i, "s": "a", "none": None, "b": True})) for i, x in enumerate(v)], "chunk_id string, vec array<double>, text string, metadata string")
    q = spark.createDataFrame([(7, v[3].tolist())], "query_id int, qvec array<double>")
    with pytest.raises(MissingIndex):
        store.search(q, 3)
    assert store.upsert(chunks, batch=5) == 12
    got = store.search(q, 3).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == [f"c{j:02}" for j in np.argsort(-(v @ v[3]))[:3]] and got[0].relevance == pytest.approx(0 if backend == "pgvector" else 1)
    store.delete(["c03"])
    assert "c03" not in {r.chunk_id for r in store.search(q, 3).collect()}
    with pytest.raises(IncompatibleIndex):
        V.ServiceStore(backend, connect, m | {"dimension": 9}).search(q, 1)
    with pytest.raises(ValueError):
        V.record("nowhere", "c", [], "", {})
    if backend == "pinecone":
        with pytest.raises(OverflowError):
            V.record(backend, "c", [1.0], "x" * 50_000, {})
    if backend == "qdrant":
        with pytest.raises(L.UnsupportedFilter):
            store.search(q, 1, where=L.Not(L.Compare("n", "eq", 1)))


def test_hosted_generation_keeps_to_what_was_shown(spark):
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2")], "query_id long, prompt string")
    shown = spark.createDataFrame([(1, "a"), (1, "b")], "query_id long, chunk_id string")
    got = {r.query_id: r for r in A.generated(prompts, shown, lambda p: f"{p} says [chunk_id:b] and [chunk_id:z] [chunk_id:b]").collect()}
    assert got[1].citations == ["b"] and "[chunk_id:z]" not in got[1].answer and "[chunk_id:b]" in got[1].answer
    assert got[2].citations == [] and "chunk_id" not in got[2].answer
    with pytest.raises(Exception, match="no answer"):
        A.generated(prompts, shown, lambda p: " ").collect()


def test_scores_tell_where_they_come_from(spark):
    r = spark.createDataFrame([(1, "a", -0.25, 1)], "query_id int, chunk_id string, relevance double, rank int")
    p = R.with_provenance(r, "cosine_distance").first().provenance
    assert (p.kind, p.conversion, p.raw_score) == ("dense", "negate", 0.25)
    with pytest.raises(ValueError):
        R.with_provenance(r, "odd")
