"""Vector stores that are services: what is written to them, and searches through a client.

A client is made in the Python worker by a function that is passed in and has ``write(records)``,
``remove(ids)`` and ``search(vector, k, filter) -> [(id, raw score)]``; no service is reachable here,
so tests bring their own.  Everything that the stores must agree on is here: ids, the forms of
records and filters, the sign of scores, manifests, and the order of results.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from . import filters
from .retrieval import top_k
from .store import IncompatibleIndex, MissingIndex, manifest_differences

BACKENDS = ("pgvector", "qdrant", "opensearch", "pinecone")
MOST_METADATA_BYTES = 40_000
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "marlstone:chunks")
#: Of the record that carries the manifest.
SENTINEL = "manifest"


def point_id(chunk_id: str) -> str:
    return str(uuid.uuid5(_SPACE, f"chunk:{chunk_id}"))


def _kind(v) -> str:
    return "null" if v is None else "flag" if isinstance(v, bool) else "word" if isinstance(v, str) else "number"


def record(backend: str, chunk_id: str, vec: list[float], text: str, metadata: dict) -> dict:
    """One chunk as the store keeps it, with metadata in the form that its filters address."""
    if backend not in BACKENDS:
        raise ValueError(f"{backend!r} is no service")
    if backend == "pgvector":
        return {"id": chunk_id, "embedding": vec, "text": text, "metadata": metadata}
    if backend == "qdrant":
        return {"id": point_id(chunk_id), "vector": vec, "payload": {"chunk_id": chunk_id, "kind": "chunk", "text": text, "metadata": metadata}}
    if backend == "opensearch":
        entries = [{"key": hashlib.sha256(k.encode()).hexdigest(), "null": v is None} | ({} if v is None else {_kind(v): v}) for k, v in sorted(metadata.items())]
        return {"_id": chunk_id, "vector": vec, "text": text, "entries": entries}
    flat = {"text": text, "source": json.dumps(metadata, sort_keys=True)}
    for k, v in metadata.items():
        stem = "m_" + hashlib.sha256(k.encode()).hexdigest()
        flat |= {f"{stem}_present": True, f"{stem}_kind": _kind(v)} | ({} if v is None else {stem: v})
    if len(json.dumps(flat).encode()) > MOST_METADATA_BYTES:
        raise OverflowError(f"the metadata of {chunk_id} exceed {MOST_METADATA_BYTES} bytes")
    return {"id": chunk_id, "values": vec, "metadata": flat}


class ServiceStore:
    def __init__(self, backend: str, connect: Callable[[], object], manifest: dict):
        if backend not in BACKENDS:
            raise ValueError(f"{backend!r} is no service")
        self.backend, self.connect, self.manifest = backend, connect, manifest

    def require(self) -> None:
        held = self.connect().manifest()
        if held is None:
            raise MissingIndex("nothing has been indexed here")
        if diff := manifest_differences(held, self.manifest):
            raise IncompatibleIndex("index and request differ in " + ", ".join(diff))

    def upsert(self, chunks: DataFrame, batch: int = 100) -> int:
        """Write (chunk_id, vec, text, metadata as JSON) in batches from the workers; their number.  The
        manifest is written first, or must agree with the one that is there."""
        client = self.connect()
        if client.manifest() is None:
            client.bind(self.manifest)
        self.require()
        backend, connect = self.backend, self.connect

        def write(batches):
            service, held = connect(), []
            for b in batches:
                for cid, vec, text, meta in zip(*(c.to_pylist() for c in b.columns)):
                    held.append(record(backend, cid, vec, text, json.loads(meta or "{}")))
                    if len(held) == batch:
                        service.write(held)
                        held = []
                yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])
            if held:
                service.write(held)

        got = chunks.select("chunk_id", "vec", "text", "metadata").mapInArrow(write, "n long").groupBy().sum("n").first()[0]
        return int(got or 0)

    def delete(self, ids: list[str]) -> None:
        self.require()
        self.connect().remove([point_id(i) for i in ids] if self.backend == "qdrant" else list(ids))

    def search(self, queries: DataFrame, k: int, where=None) -> DataFrame:
        """(query_id, chunk_id, raw_score, relevance, rank) for queries (query_id, qvec).  A distance
        becomes its negative; what a service returns is ordered again, ids breaking ties."""
        self.require()
        form, connect, sign = filters.for_backend(where, self.backend), self.connect, -1.0 if self.backend == "pgvector" else 1.0

        def ask(batches):
            service = connect()
            for b in batches:
                rows = [{"query_id": q, "chunk_id": c, "raw_score": s, "relevance": sign * s} for q, v in zip(*(c.to_pylist() for c in b.columns)) for c, s in service.search(v, k, form)]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("query_id", b.schema.field(0).type), ("chunk_id", pa.string()), ("raw_score", pa.float64()), ("relevance", pa.float64())]))

        kind = queries.schema["query_id"].dataType.simpleString()
        return top_k(queries.select("query_id", "qvec").mapInArrow(ask, f"query_id {kind}, chunk_id string, raw_score double, relevance double"), k)
