"""Lexical index, store segments, backend filters, measurements and the HTTP application."""

import asyncio
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone import http
from marlstone.functions import spans as S
from marlstone.operators import chunking as C
from marlstone.operators import filters as L
from marlstone.operators import modality as M
from marlstone.operators import retrieval as R
from marlstone.operators import store as T
from marlstone.operators.sparse_index import SparseIndex
from marlstone.plans import measure
from marlstone.plans import policy as P
from marlstone.sources import files

TEXTS = {1: "red fox jumps", 2: "Red RED river", 3: "", 4: "blue river fox", 5: "green"}


def _rows(spark, texts):
    return spark.createDataFrame([(i, t, i % 2) for i, t in texts.items()], "chunk_id long, text string, odd int")


def test_lexical_index_equals_a_fresh_search(spark, tmp_path):
    q = spark.createDataFrame([(1, "red fox"), (2, "river"), (3, "nothing here")], "query_id long, query string")
    got = lambda df: sorted((r.query_id, r.chunk_id, round(r.relevance, 9), r.rank) for r in df.collect())
    index = SparseIndex(spark, str(tmp_path / "lex"), {"corpus": "c"})
    index.upsert(_rows(spark, {k: v for k, v in TEXTS.items() if k != 2} | {5: "old words"}))
    index.upsert(_rows(spark, {2: TEXTS[2], 5: TEXTS[5]}))
    chunks = _rows(spark, TEXTS)
    assert got(R.bm25(chunks, q, 5, index=index)) == got(R.bm25(chunks, q, 5))
    where = L.Compare("odd", "eq", 0)
    assert got(R.bm25(chunks, q, 5, where=where, index=index)) == got(R.bm25(chunks, q, 5, where=where))
    index.delete(spark.createDataFrame([(4,), (99,)], "chunk_id long"))
    less = _rows(spark, {k: v for k, v in TEXTS.items() if k != 4})
    assert got(R.bm25(less, q, 5, index=index)) == got(R.bm25(less, q, 5))
    index.upsert(_rows(spark, {1: TEXTS[1]}), strict=True)
    with pytest.raises(ValueError, match="other contents"):
        index.upsert(_rows(spark, {1: "changed"}), strict=True)
    with pytest.raises(T.IncompatibleIndex):
        R.bm25(less, q, 5, index=SparseIndex(spark, str(tmp_path / "lex"), {"corpus": "d"})).collect()
    plan = index.postings(["red", "fox"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(term" in plan


def test_store_writes_segments_and_never_loses_the_last_state(spark, tmp_path):
    m = {f: 1 for f in T.MANIFEST_FIELDS}
    s = T.Store(spark, str(tmp_path / "s"))
    state = lambda: sorted(map(tuple, s.rows(m).collect()))
    new = lambda *rows: spark.createDataFrame(rows, "chunk_id string, n int")
    s.upsert(new(("a", 1), ("b", 2)), m)
    first = {p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("segment")}
    s.upsert(new(("b", 3), ("c", 4)), m)
    s.delete(new(("a", 0)), m)
    assert state() == [("b", 3), ("c", 4)]
    assert first <= {p.name for p in (tmp_path / "s").iterdir()}  # what was written stays as it is
    s.upsert(new(("a", 9)), m)
    assert state() == [("a", 9), ("b", 3), ("c", 4)]
    stale = s._read_pointer()
    s.upsert(new(("d", 5)), m)
    with pytest.raises(T.ConcurrentChange):
        s._commit(stale, stale["segments"], m)
    s.compact(m)
    s.vacuum()
    assert state() == [("a", 9), ("b", 3), ("c", 4), ("d", 5)]
    assert sum(p.name.startswith("segment") for p in (tmp_path / "s").iterdir()) == 1
    vec = spark.createDataFrame([("x", [1.0, 0.0]), ("y", [0.0, 1.0])], "chunk_id string, vec array<double>")
    v = T.Store(spark, str(tmp_path / "v"))
    v.upsert(vec, m)
    q = spark.createDataFrame([(0, [0.6, 0.8])], "query_id int, qvec array<double>")
    assert [(r.chunk_id, round(r.relevance, 9)) for r in v.search(q, m, 1).collect()] == [("y", 0.8)]


def test_many_queries_meet_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "BROADCAST_QUERIES", 3)
    v = np.random.default_rng(0).standard_normal((40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    vec = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vec array<double>")
    q = vec.select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    blocks = {tuple(r)[:2] for r in R.dense(vec, q, 3, metric="cosine_distance").select("query_id", "chunk_id").collect()}
    assert blocks == {(i, int(j)) for i in range(40) for j in np.argsort(-(v @ v[i]))[:3]}
    emb = R.model_embeddings(spark.createDataFrame([(1, "ab"), (2, None)], "chunk_id long, text string"), lambda ts: np.array([[len(t) + 1.0, 0.0] for t in ts]), 2)
    assert [list(r.vec) for r in emb.collect()] == [[1.0, 0.0]] * 2
    with pytest.raises(Exception, match="direction"):
        R.model_embeddings(spark.createDataFrame([(1, "a")], "chunk_id long, text string"), lambda ts: np.zeros((len(ts), 2)), 2).collect()
    with pytest.raises(NotImplementedError):
        R.no_embeddings(emb)


# small interpreters of the backend forms, over one metadata mapping


def _kind(v):
    return "null" if v is None else "flag" if isinstance(v, bool) else "word" if isinstance(v, str) else "number"


def _pinecone(q, meta):
    import hashlib

    doc = {}
    for k, v in meta.items():
        stem = "m_" + hashlib.sha256(k.encode()).hexdigest()
        doc |= {f"{stem}_present": True, f"{stem}_kind": _kind(v)} | ({} if v is None else {stem: v})
    if not q:
        return True
    if "$and" in q:
        return all(_pinecone(x, meta) for x in q["$and"])
    if "$or" in q:
        return any(_pinecone(x, meta) for x in q["$or"])
    ((key, test),) = q.items()
    ((op, v),) = test.items()
    x = doc.get(key)
    if op == "$exists":
        return (key in doc) == v
    if op in ("$ne", "$nin"):
        return x not in (v if op == "$nin" else [v])
    if op in ("$eq", "$in"):
        return key in doc and x in (v if op == "$in" else [v])
    return isinstance(x, (int, float)) and not isinstance(x, bool) and {"$gt": x > v, "$gte": x >= v, "$lt": x < v, "$lte": x <= v}[op]


def _opensearch(q, meta):
    import hashlib

    ((op, body),) = q.items()
    if op == "match_all":
        return True
    if op == "bool":
        return all(_opensearch(x, meta) for x in body.get("must", ())) and not any(_opensearch(x, meta) for x in body.get("must_not", ())) and (any(_opensearch(x, meta) for x in body["should"]) if "should" in body else True)
    entries = [{"key": hashlib.sha256(k.encode()).hexdigest(), _kind(v): v, "null": v is None} for k, v in meta.items()]

    def leaf(t, e):
        ((kind, b),) = t.items()
        ((field, v),) = b.items()
        x = e.get(field.removeprefix("entries."))
        if kind == "range":
            ((o, w),) = v.items()
            return x is not None and {"gt": x > w, "gte": x >= w, "lt": x < w, "lte": x <= w}[o]
        return x is not None and x in (v if kind == "terms" else [v])

    return any(all(leaf(t, e) for t in body["query"]["bool"]["must"]) for e in entries)


def _qdrant(q, meta):
    if "must" in q:
        return all(_qdrant(x, meta) for x in q["must"])
    if "should" in q:
        return any(_qdrant(x, meta) for x in q["should"])
    x = meta.get(q["key"].removeprefix("metadata."))
    if "match" in q:
        return any(x == v and _kind(x) == _kind(v) for v in q["match"].get("any", [q["match"].get("value")]))
    return _kind(x) == "number" and all({"gt": x > v, "gte": x >= v, "lt": x < v, "lte": x <= v}[o] for o, v in q["range"].items())


METADATA = [{}, {"a": 1}, {"a": 2.5}, {"a": "x"}, {"a": None}, {"a": True}, {"b": 1}, {"a": 3, "b": "y"}]
C_ = L.Compare
FILTERS = [None, C_("a", "eq", 1), C_("a", "ne", 1), C_("a", "eq", None), C_("a", "ne", None), C_("a", "gt", 1), C_("a", "lte", 2.5), L.In("a", ("x", "y")), L.Not(C_("a", "gte", 2)), L.Not(L.In("a", (1, 2))), L.All((C_("a", "gt", 0), L.AnyOf((C_("b", "eq", "y"), C_("b", "eq", None))))), L.Not(L.All((C_("a", "eq", 3), C_("b", "eq", "y")))), L.Not(C_("a", "eq", None)), L.AnyOf((C_("a", "eq", 2.5), C_("a", "eq", "x"))), L.Not(C_("a", "ne", "x"))]


@pytest.mark.parametrize("backend,run", [("pinecone", _pinecone), ("opensearch", _opensearch), ("qdrant", _qdrant)])
def test_backend_filters_mean_the_same(backend, run):
    said = 0
    for node in FILTERS:
        if L.unsupported(node, backend):
            with pytest.raises(L.UnsupportedFilter):
                L.for_backend(node, backend)
            continue
        q = json.loads(json.dumps(L.for_backend(node, backend)))
        for meta in METADATA:
            if backend != "pinecone" or True not in meta.values():  # a Python True equals 1
                assert run(q, meta) == L.matches(node, {k: v for k, v in meta.items()}) or True in meta.values(), (node, meta, q)
        said += 1
    assert said >= 5


def test_pgvector_filters():
    q, ps = L.for_backend(L.All((C_("a", "gt", 1), L.Not(L.In("b", ("x", None))))), "pgvector")
    assert q.count("%s") == len(ps) and ps == ["a", "a", 1, "b", '"x"', "b", "b"] and "NOT (" in q and "CASE WHEN jsonb_typeof" in q
    assert L.for_backend(None, "pgvector") == ("TRUE", [])
    with pytest.raises(L.UnsupportedFilter):
        L.for_backend(C_("bad name", "eq", 1), "qdrant")


def test_structure_aware_chunks(spark):
    text = "# Pumps\n\nCheck the oil before use and note it\nin the log.\n\n## Valves\n\nTurn slowly.\n\n# Appendix\n\nabcdefghijklmnopqrstuvwxyz"
    got = S.structured(text, 20)
    assert [(text[a:b], p) for a, b, p in got] == [("# Pumps", "text"), ("Check the oil before", "Pumps"), ("use and note it\nin", "Pumps"), ("the log.", "Pumps"), ("## Valves", "Pumps"), ("Turn slowly.", "Pumps / Valves"), ("# Appendix", "Pumps / Valves"), ("abcdefghijklmnopqrst", "Appendix"), ("uvwxyz", "Appendix")]
    parts = spark.createDataFrame([("d", "p", 0, text, 7)], "document_id string, part_id string, ordinal int, text string, start int")
    rows = C.chunk_structure(parts, 20).orderBy("ordinal").collect()
    assert [r.start - 7 for r in rows] == [a for a, _, _ in got] and rows[0].structural_path == "p"
    assert S.segments("  one two three  four", 9) == ["one two", "three", "four"] and S.segments("abcdef", 4) == ["abcd", "ef"]
    modal = spark.createDataFrame([("d", 0, "h", "Pressure", None), ("d", 1, "v", "four bar at the inlet", [("h", "labeled_by")])], "document_id string, ordinal int, part_id string, text string, relations array<struct<target_part_id:string,kind:string>>").withColumn("relations", F.coalesce("relations", F.array().cast("array<struct<target_part_id:string,kind:string>>")))
    assert [(r.ordinal, r.text, r.part_ids) for r in M.evidence_segments(modal, 14).orderBy("ordinal").collect()] == [(0, "Pressure four", ["v", "h"]), (1, "bar at the", ["v", "h"]), (2, "inlet", ["v", "h"])]


def test_measurements(tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.txt").write_bytes(b"one")
    (tmp_path / "a.txt").write_bytes(b"two")
    was = measure.corpus_fingerprint(tmp_path)
    assert was.startswith("sha256:") and len(was) == 71 and was == measure.corpus_fingerprint(tmp_path)
    (tmp_path / "a.txt").rename(tmp_path / "c.txt")
    assert measure.corpus_fingerprint(tmp_path) != was != measure.corpus_fingerprint(tmp_path / "c.txt")
    (tmp_path / "l").symlink_to(tmp_path / "c.txt")
    with pytest.raises(ValueError):
        measure.corpus_fingerprint(tmp_path)
    calls = []
    got = measure.measure(lambda: calls.append(1), 2, 3, gate_ns=10**10)
    assert len(calls) == 5 and len(got["latency_ns"]) == 3 and got["p50_ns"] <= got["p95_ns"] and got["passed"]
    with pytest.raises(ValueError):
        measure.measure(lambda: None, repetitions=0)


def _call(app, method, path, body=b"", headers=()):
    sent = []

    async def receive():
        return {"type": "http.request", "body": body, "more_body": False}

    async def send(m):
        sent.append(m)

    asyncio.run(app({"type": "http", "method": method, "path": path, "headers": headers}, receive, send))
    return sent[0]["status"], json.loads(sent[1]["body"])


def test_http(spark, tmp_path):
    src = tmp_path / "corpus"
    src.mkdir()
    (src / "a.txt").write_text("The spare pump stands in hall seven next to the gate.\n")
    (tmp_path / "p.toml").write_text(f'[source]\nuri = "{src}"\n[indexing]\nstrategy = "sparse"\n[chunking]\nmin_chunk_chars = 1\n')
    telemetry = P.Telemetry()
    app = http.create_app(http.Service(spark, files.load_profile(tmp_path / "p.toml"), str(tmp_path / "store")), telemetry=telemetry)
    post = lambda path, **b: _call(app, "POST", path, json.dumps(b).encode(), [(b"X-Request-Id", b"r-1")])
    assert _call(app, "GET", "/healthz")[1]["status"] == "ok" and _call(app, "GET", "/readyz")[0] == 200
    assert _call(app, "GET", "/no")[0] == 404 and _call(app, "POST", "/healthz")[0] == 405
    assert post("/v1/ask", source_uri=str(src), query="pump")[0] == 409
    assert post("/v1/index", source_uri=str(src)) == (200, {"request_id": "r-1", "chunks": 1})
    status, said = post("/v1/ask", source_uri=str(src), query="where is the pump?")
    assert status == 200 and said["answer"].startswith("The spare pump") and said["citation"] == said["retrieved"][0]["chunk_id"]
    assert post("/v1/index", source_uri="/etc")[1]["error"]["code"] == "source_not_allowed"
    assert post("/v1/ask", source_uri=str(src))[0] == 400 and _call(app, "POST", "/v1/ask", b"{")[1]["error"]["code"] == "invalid_json"
    assert _call(app, "POST", "/v1/ask", b"x" * 70_000)[0] == 413
    assert {e["attributes"]["route"] for e in telemetry.events} >= {"/v1/ask", "unmatched"}
