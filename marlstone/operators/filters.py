"""Metadata predicates: a two-valued AST, its JSON form, and a compiler to Spark columns.

A missing key equals null; ordering holds only between two strings (code points) or two numbers
(booleans aside) and is false otherwise, so no leaf is ever null and NOT is exact.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scalar = str | int | float | bool | None
_COMPARE = ("eq", "ne", "gt", "gte", "lt", "lte")


def _scalar(v) -> None:
    if not (v is None or isinstance(v, (str, bool, int, float))) or (isinstance(v, float) and not math.isfinite(v)):
        raise ValueError(f"{v!r} is no finite scalar")


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    value: Scalar

    def __post_init__(self):
        if not self.field or self.op not in _COMPARE:
            raise ValueError("a comparison needs a field and a known operator")
        _scalar(self.value)


@dataclass(frozen=True)
class In:
    field: str
    values: tuple[Scalar, ...]

    def __post_init__(self):
        if not self.field or not self.values:
            raise ValueError("IN needs a field and at least one value")
        for v in self.values:
            _scalar(v)


@dataclass(frozen=True)
class All:
    terms: tuple


@dataclass(frozen=True)
class AnyOf:
    terms: tuple


@dataclass(frozen=True)
class Not:
    term: object


def to_dict(node) -> dict:
    match node:
        case Compare(f, op, v):
            return {"kind": "comparison", "field": f, "operator": op, "value": v}
        case In(f, vs):
            return {"kind": "in", "field": f, "values": list(vs)}
        case All(ts):
            return {"kind": "and", "operands": [to_dict(t) for t in ts]}
        case AnyOf(ts):
            return {"kind": "or", "operands": [to_dict(t) for t in ts]}
        case Not(t):
            return {"kind": "not", "operand": to_dict(t)}
    raise ValueError(f"{node!r} is no filter")


def from_dict(d: dict):
    match d:
        case {"kind": "comparison", "field": f, "operator": op, "value": v}:
            return Compare(f, op, v)
        case {"kind": "in", "field": f, "values": vs}:
            return In(f, tuple(vs))
        case {"kind": "and", "operands": ts}:
            return All(tuple(map(from_dict, ts)))
        case {"kind": "or", "operands": ts}:
            return AnyOf(tuple(map(from_dict, ts)))
        case {"kind": "not", "operand": t}:
            return Not(from_dict(t))
    raise ValueError(f"{d!r} is no filter")


class ColumnFields:
    """Fields that are typed columns of a DataFrame; a column that isn't there is missing."""

    def __init__(self, df: DataFrame):
        self.types = {f.name: f.dataType for f in df.schema.fields}

    def leaf(self, field: str, op: str, v: Scalar) -> Column:
        kind = self.types.get(field)
        c = F.col(f"`{field}`")
        if v is None:
            return F.lit(op == "eq") if kind is None else c.isNull() if op == "eq" else F.lit(False)
        if kind is None:
            return F.lit(False)
        number = isinstance(kind, T.NumericType)
        if isinstance(kind, T.BooleanType) and op == "eq" and not isinstance(v, str):
            c, number = c.cast("double"), True  # true equals 1 and 1.0
            v = float(v)
        same = isinstance(kind, T.StringType) if isinstance(v, str) else number
        if not same or (op != "eq" and isinstance(v, bool)):
            return F.lit(False)
        if number:
            v = float(v) if isinstance(v, (bool, float)) or isinstance(kind, (T.DoubleType, T.FloatType)) else v
        return F.coalesce(_apply(c, op, F.lit(v)), F.lit(False))


class VariantFields:
    """Fields of a VARIANT column; every leaf tests the stored type before it compares."""

    NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"

    def __init__(self, column: str):
        self.column = column

    def leaf(self, field: str, op: str, v: Scalar) -> Column:
        path = "$[" + '"' + field.replace("\\", "\\\\").replace('"', '\\"') + '"]'
        node = F.try_variant_get(F.col(self.column), path, "variant")
        kind = F.schema_of_variant(node)
        if v is None:
            return (node.isNull() | F.is_variant_null(node)) if op == "eq" else F.lit(False)
        get = lambda t: F.try_variant_get(F.col(self.column), path, t)
        if isinstance(v, str):
            hit = (kind == "STRING") & _apply(get("string"), op, F.lit(v))
        else:
            hit = kind.rlike(self.NUMBERS) & _apply(get("double"), op, F.lit(float(v)))
            if op == "eq" and v in (0, 1):
                hit = F.coalesce(hit, F.lit(False)) | ((kind == "BOOLEAN") & (get("boolean") == F.lit(bool(v))))
            elif isinstance(v, bool):
                return F.lit(False)
        return F.coalesce(hit, F.lit(False))


def _apply(c: Column, op: str, v: Column) -> Column:
    return {"eq": c == v, "gt": c > v, "gte": c >= v, "lt": c < v, "lte": c <= v}[op]


def compile_filter(node, fields) -> Column:
    """A column that is true or false on every row; ``fields``: ColumnFields or VariantFields."""
    match node:
        case None:
            return F.lit(True)
        case Compare(f, "ne", v):
            return ~fields.leaf(f, "eq", v)
        case Compare(f, op, v):
            return fields.leaf(f, op, v)
        case In(f, vs):
            return reduce(Column.__or__, [fields.leaf(f, "eq", v) for v in vs])
        case All(ts):
            return reduce(Column.__and__, [compile_filter(t, fields) for t in ts], F.lit(True))
        case AnyOf(ts):
            return reduce(Column.__or__, [compile_filter(t, fields) for t in ts], F.lit(False))
        case Not(t):
            return ~compile_filter(t, fields)
    raise ValueError(f"{node!r} is no filter")


def matches(node, metadata: dict) -> bool:
    """The same predicate on one Python mapping."""
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    match node:
        case None:
            return True
        case Compare(f, "eq", v):
            return metadata.get(f) == v
        case Compare(f, "ne", v):
            return metadata.get(f) != v
        case Compare(f, op, v):
            x = metadata.get(f)
            if not ((isinstance(x, str) and isinstance(v, str)) or (number(x) and number(v))):
                return False
            x, v = (x, v) if isinstance(x, str) else (float(x), float(v))
            return {"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[op]
        case In(f, vs):
            return any(metadata.get(f) == v for v in vs)
        case All(ts):
            return all(matches(t, metadata) for t in ts)
        case AnyOf(ts):
            return any(matches(t, metadata) for t in ts)
        case Not(t):
            return not matches(t, metadata)
    raise ValueError(f"{node!r} is no filter")


#: What a service backend can't push down: (kinds of node, test of a leaf) by backend.
def unsupported(node, backend: str) -> str | None:
    """The first reason why ``backend`` refuses a filter, or None."""
    match node:
        case None:
            return None
        case All(ts) | AnyOf(ts):
            return next((r for t in ts if (r := unsupported(t, backend))), None)
        case Not(t):
            return "no negation" if backend == "qdrant" else unsupported(t, backend)
        case In(_, vs):
            if backend == "pgvector":
                return None
            if len({type(v) for v in vs}) > 1:
                return "mixed types in IN"
            if backend == "qdrant" and any(isinstance(v, float) or v is None for v in vs):
                return "float or null in IN"
            return None
        case Compare(_, op, v):
            ordered = op not in ("eq", "ne")
            if ordered and (v is None or isinstance(v, bool)):
                return "no order on null and booleans"
            if backend == "pgvector":
                return None
            if ordered and isinstance(v, str):
                return "no order on strings"
            if backend == "qdrant" and (op == "ne" or v is None):
                return "no inequality and no null"
            return None
    raise ValueError(f"{node!r} is no filter")


class UnsupportedFilter(ValueError):
    pass


def for_backend(node, backend: str):
    """The filter as ``backend`` takes it: (SQL, parameters) over a jsonb column for pgvector, a JSON
    object for qdrant, opensearch and pinecone; UnsupportedFilter where it can't be said exactly."""
    if reason := unsupported(node, backend):
        raise UnsupportedFilter(f"{backend}: {reason}")
    return {"pgvector": _pgvector, "qdrant": _qdrant, "opensearch": _opensearch, "pinecone": _pinecone}[backend](node)


_SIGN = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _pgvector(node) -> tuple[str, list]:
    many = lambda word, ts, none: (f" {word} ".join(f"({q})" for q, _ in ts) or none, [x for _, ps in ts for x in ps])
    match node:
        case None:
            return "TRUE", []
        case Compare(f, "eq", None):
            return "NOT (metadata ? %s) OR metadata -> %s = 'null'::jsonb", [f, f]
        case Compare(f, "eq", v):
            return "COALESCE(metadata -> %s = %s::jsonb, FALSE)", [f, json.dumps(v, ensure_ascii=False)]
        case Compare(f, "ne", v):
            q, ps = _pgvector(Compare(f, "eq", v))
            return f"NOT ({q})", ps
        case Compare(f, op, str() as v):
            return f"""COALESCE(jsonb_typeof(metadata -> %s) = 'string' AND (metadata ->> %s) COLLATE "C" {_SIGN[op]} %s, FALSE)""", [f, f, v]
        case Compare(f, op, v):
            # a CASE, since AND doesn't promise to test the type before the cast
            return f"COALESCE(CASE WHEN jsonb_typeof(metadata -> %s) = 'number' THEN (metadata ->> %s)::double precision {_SIGN[op]} %s END, FALSE)", [f, f, v]
        case In(f, vs):
            return _pgvector(AnyOf(tuple(Compare(f, "eq", v) for v in vs)))
        case All(ts):
            return many("AND", [_pgvector(t) for t in ts], "TRUE")
        case AnyOf(ts):
            return many("OR", [_pgvector(t) for t in ts], "FALSE")
        case Not(t):
            q, ps = _pgvector(t)
            return f"NOT ({q})", ps


def _qdrant(node) -> dict:
    match node:
        case None:
            return {"must": []}
        case Compare(f) | In(f) if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", f):
            raise UnsupportedFilter("qdrant: no such field name")
        case Compare(f, "eq", float() as v):
            return {"key": f"metadata.{f}", "range": {"gte": v, "lte": v}}
        case Compare(f, "eq", v):
            return {"key": f"metadata.{f}", "match": {"value": v}}
        case Compare(f, op, v):
            return {"key": f"metadata.{f}", "range": {op: v}}
        case In(f, vs):
            return {"key": f"metadata.{f}", "match": {"any": list(vs)}}
        case All(ts):
            return {"must": [_qdrant(t) for t in ts]}
        case AnyOf(ts):
            return {"should": [_qdrant(t) for t in ts]}


def _entry(v) -> str:
    """The typed field of a nested metadata entry."""
    return "entries." + ("flag" if isinstance(v, bool) else "word" if isinstance(v, str) else "number")


def _opensearch(node, negated: bool = False) -> dict:
    key = lambda f: {"term": {"entries.key": hashlib.sha256(f.encode()).hexdigest()}}
    inside = lambda *q: {"nested": {"path": "entries", "query": {"bool": {"must": list(q)}}}}
    some = lambda qs: {"bool": {"should": qs, "minimum_should_match": 1}}
    match node:
        case None:
            return {"match_all": {}}
        case Not(t):
            return _opensearch(t, not negated)
        case All(ts) | AnyOf(ts):
            qs = [_opensearch(t, negated) for t in ts]
            return {"bool": {"must": qs}} if isinstance(node, All) != negated else some(qs)
        case Compare(f, "ne", v):
            return _opensearch(Compare(f, "eq", v), not negated)
        case Compare(f, "eq", None):
            q = some([{"bool": {"must_not": [inside(key(f))]}}, inside(key(f), {"term": {"entries.null": True}})])
        case Compare(f, "eq", v):
            q = inside(key(f), {"term": {_entry(v): v}})
        case Compare(f, op, v):
            q = inside(key(f), {"range": {_entry(v): {op: v}}})
        case In(f, vs) if vs[0] is None:
            q = _opensearch(Compare(f, "eq", None))
        case In(f, vs):
            q = inside(key(f), {"terms": {_entry(vs[0]): list(vs)}})
    return {"bool": {"must_not": [q]}} if negated else q


def _pinecone(node, negated: bool = False) -> dict:
    """Fields are kept as ``<hash>`` with ``<hash>_present`` and ``<hash>_kind`` beside them, since a
    negation must hold for missing keys and for values of another type."""
    stem = lambda f: "m_" + hashlib.sha256(f.encode()).hexdigest()
    kind = lambda v: "null" if v is None else "flag" if isinstance(v, bool) else "word" if isinstance(v, str) else "number"
    match node:
        case None:
            return {}
        case Not(t):
            return _pinecone(t, not negated)
        case All(ts) | AnyOf(ts):
            return {"$and" if isinstance(node, All) != negated else "$or": [_pinecone(t, negated) for t in ts]}
        case Compare(f, "ne", v):
            return _pinecone(Compare(f, "eq", v), not negated)
        case Compare(f, "eq", None) if not negated:
            return {"$or": [{f"{stem(f)}_present": {"$exists": False}}, {f"{stem(f)}_kind": {"$eq": "null"}}]}
        case Compare(f, "eq", None):
            return {"$and": [{f"{stem(f)}_present": {"$exists": True}}, {f"{stem(f)}_kind": {"$ne": "null"}}]}
        case Compare(f, "eq", v):
            yes, no, w = {"$eq": v}, {"$ne": v}, v
        case Compare(f, op, v):
            other = {"gt": "lte", "gte": "lt", "lt": "gte", "lte": "gt"}[op]
            yes, no, w = {f"${op}": v}, {f"${other}": v}, v
        case In(f, vs) if vs[0] is None:
            return _pinecone(Compare(f, "eq", None), negated)
        case In(f, vs):
            yes, no, w = {"$in": list(vs)}, {"$nin": list(vs)}, vs[0]
    if not negated:
        return {"$and": [{f"{stem(f)}_kind": {"$eq": kind(w)}}, {stem(f): yes}]}
    return {"$or": [{f"{stem(f)}_present": {"$exists": False}}, {f"{stem(f)}_kind": {"$ne": kind(w)}}, {stem(f): no}]}
