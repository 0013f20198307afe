"""Content identities: canonical JSON and prefixed SHA-256 ids."""

from __future__ import annotations

import hashlib
import json
import math
import unicodedata
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = {"src": "source", "doc": "document", "cmp": "component", "chk": "chunk"}
_NAMESPACE = "marlstone"


def canonical(value):
    """The value with NFC text and LF line ends; NaN, infinities and odd keys are refused."""
    match value:
        case bool() | int() | None:
            return value
        case str():
            return unicodedata.normalize("NFC", value.replace("\r\n", "\n").replace("\r", "\n"))
        case float():
            if math.isfinite(value):
                return value
            raise ValueError("a canonical number is finite")
        case Mapping():
            if any(not isinstance(k, str) for k in value):
                raise ValueError("a canonical object has string keys")
            return {k: canonical(v) for k, v in value.items()}
        case list() | tuple():
            return [canonical(v) for v in value]
    raise ValueError(f"no canonical form for {type(value).__name__}")


def canonical_json(value) -> str:
    return json.dumps(canonical(value), ensure_ascii=False, allow_nan=False, sort_keys=True, separators=(",", ":"))


def stable_id(prefix: str, payload) -> str:
    body = canonical_json({"namespace": f"{_NAMESPACE}:{_SPACE[prefix]}:v1", "payload": payload})
    return f"{prefix}_v1_{hashlib.sha256(body.encode()).hexdigest()}"


def source_id(connector: str, locator: Mapping) -> str:
    if not connector:
        raise ValueError("a source needs a connector")
    return stable_id("src", {"connector": connector, "locator": dict(locator)})


def document_id(source: str, digests: list[str], boundary: str = "") -> str:
    if not digests or any(len(d) != 64 or set(d) - set("0123456789abcdef") for d in digests):
        raise ValueError("a document needs full lower-case SHA-256 digests of its assets")
    return stable_id("doc", {"source_id": source, "asset_digests": list(digests), "boundary": boundary})


def component_id(kind: str, implementation: str, configuration: Mapping) -> str:
    if not kind or not implementation:
        raise ValueError("a component needs a kind and an implementation")
    return stable_id("cmp", {"kind": kind, "implementation": implementation, "configuration": dict(configuration)})


def chunk_id(document: str, chunker: str, parts: list[tuple[str, Mapping]], text: str) -> str:
    """Metadata and ordinal play no part."""
    if not parts or not text:
        raise ValueError("a chunk needs parts and text")
    return stable_id("chk", {"document_id": document, "chunker": chunker, "parts": [{"part_id": p, "locator": dict(loc)} for p, loc in parts], "representation": text})


def text_span(start: int, end: int) -> dict:
    return {"kind": "text_span", "start": start, "end": end}


def chunk_id_column(chunker: str, document: Column, part: Column, start: Column, end: Column, text: Column) -> Column:
    """Ids of exact text chunks by an Arrow UDF, which normalises text as :func:`chunk_id` does."""

    @F.pandas_udf("string")
    def make(document: pd.Series, part: pd.Series, start: pd.Series, end: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([chunk_id(d, chunker, [(p, text_span(int(s), int(e)))], t) for d, p, s, e, t in zip(document, part, start, end, text)])

    return make(document, part, start, end, text)


def chunk_id_sql(chunker: str, document: Column, part: Column, start: Column, end: Column, text: Column) -> Column:
    """The same inside the JVM, for text that is already NFC and free of CR.

    Field order is alphabetical, as canonical JSON has it.
    """
    payload = F.struct(
        F.lit(chunker).alias("chunker"), document.alias("document_id"),
        F.array(F.struct(F.struct(end.cast("int").alias("end"), F.lit("text_span").alias("kind"), start.cast("int").alias("start")).alias("locator"), part.alias("part_id"))).alias("parts"),
        text.alias("representation"),
    )
    body = F.to_json(F.struct(F.lit(f"{_NAMESPACE}:chunk:v1").alias("namespace"), payload.alias("payload")))
    return F.concat(F.lit("chk_v1_"), F.sha2(body, 256))
