"""Control plane: policies, manifests, registries, capability checks, telemetry."""

from __future__ import annotations

import importlib.util
import json
import os
import re
import shutil
import time
import uuid
from contextlib import contextmanager
from pathlib import Path

from ..functions import ids
from ..operators.chunking import MATRIX, resolve

#: Physical indexes that each vector store takes, its default first.
PHYSICAL = {
    "in_memory": ("exact",), "parquet": ("exact",), "sqlite": ("exact",), "pgvector": ("exact", "hnsw", "ivf_flat"),
    "qdrant": ("hnsw",), "opensearch": ("hnsw",), "pinecone": ("managed",),
}
#: Stores that run inside Spark; the others are services behind the same interface.
LOCAL = ("in_memory", "parquet", "sqlite")
STRATEGIES = ("auto", "dense", "sparse", "hybrid")


def indexing(strategy: str = "auto", database: str | None = None, physical: str = "default") -> dict:
    """The resolved indexing policy: auto is dense, sparse has no vector store, and the physical
    index is one that the store takes."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown indexing strategy {strategy!r}")
    strategy = "dense" if strategy == "auto" else strategy
    if strategy == "sparse":
        if database or physical != "default":
            raise ValueError("a sparse index has no vector store")
        return {"strategy": strategy, "vector_database": None, "physical_index": None}
    database = database or "in_memory"
    if database not in PHYSICAL:
        raise ValueError(f"unknown vector store {database!r}")
    physical = PHYSICAL[database][0] if physical == "default" else physical
    if physical not in PHYSICAL[database]:
        raise ValueError(f"{database} takes no {physical} index")
    return {"strategy": strategy, "vector_database": database, "physical_index": physical}


def indexing_fingerprint(policy: dict, codec: dict | None = None) -> str:
    return ids.component_id("indexing", "policy", {**policy, "codec": codec or {}})


def manifest(uri: str, profile: dict) -> dict:
    """The fields that an index and a request must share."""
    c, i = profile["chunking"], profile["indexing"]
    family = profile["profile"]["family"]
    strategy = MATRIX[family][0] if c["strategy"] == "auto" else c["strategy"]
    dense = indexing(i["strategy"], None if i["strategy"] == "sparse" else i["vector_database"], i["physical_index"])
    return {
        "schema_version": 2,
        "corpus": ids.component_id("corpus", "files", {"uri": uri, **{k: profile["source"][k] for k in ("max_files", "max_bytes")}}),
        "chunker": ids.component_id("chunker", "spans", {**c, "strategy": strategy, "family": family}),
        "embedder": ids.component_id("embedder", "hashing", {"dimension": i["dimension"]}),
        "dimension": i["dimension"],
        "normalization": "l2",
        "domain_schema": ids.component_id("schema", "chunks", {"version": 1}),
        "indexing": indexing_fingerprint(dense),
    }


class Registry:
    """Named factories; an unknown or doubly registered name is an error."""

    def __init__(self, kind: str):
        self.kind, self.made = kind, {}

    def register(self, name: str, factory) -> None:
        if name in self.made:
            raise ValueError(f"{self.kind} {name!r} is registered already")
        self.made[name] = factory

    def create(self, name: str, *args, **kw):
        if name not in self.made:
            raise LookupError(f"no {self.kind} {name!r}; there are: {', '.join(sorted(self.made))}")
        return self.made[name](*args, **kw)


#: Extension points: DataFrame -> DataFrame functions, by the part that they play.
PORTS = {p: Registry(p) for p in ("source", "classifier", "extractor", "projector", "chunker", "embedder", "vector_store", "retriever", "sparse_index", "reranker", "prompt_builder", "generator", "evaluator", "telemetry")}


def capabilities(modules=("torch", "transformers", "qdrant_client", "opensearchpy", "pinecone", "psycopg"), programs=("tesseract", "ffprobe"), secrets=("PINECONE_API_KEY",)) -> dict[str, bool]:
    """Which optional modules, programs and credentials are there; nothing is imported."""
    found = {f"module:{m}": importlib.util.find_spec(m) is not None for m in modules}
    found |= {f"program:{p}": shutil.which(p) is not None for p in programs}
    return found | {f"credential:{s}": bool(os.environ.get(s)) for s in secrets}


_SENSITIVE = re.compile(r"password|secret|token|api_?key|authorization|prompt|answer|text|query", re.I)


class Telemetry:
    """Timed stages as JSON lines; attributes are scalars, few, and never sensitive by name."""

    MOST = 16

    def __init__(self, path: str | Path | None = None):
        self.path, self.events, self.correlation = path, [], uuid.uuid4().hex

    def record(self, name: str, start_ns: int, end_ns: int, **attributes) -> dict:
        if end_ns < start_ns or len(attributes) > self.MOST:
            raise ValueError("an event ends after it starts and has few attributes")
        for k, v in attributes.items():
            if _SENSITIVE.search(k) or not (v is None or isinstance(v, (bool, int, float)) or (isinstance(v, str) and len(v) <= 256)):
                raise ValueError(f"attribute {k!r} isn't recorded")
        e = {"name": name, "start_ns": start_ns, "end_ns": end_ns, "correlation_id": self.correlation, "attributes": attributes}
        self.events.append(e)
        if self.path:
            with Path(self.path).open("a") as f:
                f.write(json.dumps(e, sort_keys=True, separators=(",", ":")) + "\n")
        return e

    @contextmanager
    def stage(self, name: str, **attributes):
        start, ok = time.monotonic_ns(), False
        try:
            yield
            ok = True
        finally:
            self.record(name, start, time.monotonic_ns(), ok=ok, **attributes)


__all__ = ["PORTS", "Registry", "Telemetry", "capabilities", "indexing", "indexing_fingerprint", "manifest", "resolve"]
