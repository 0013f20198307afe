"""Every query of the catalogue against its SQL on the smallest tables, and files to answers."""

import json
from pathlib import Path

import duckdb
import pytest

from marlstone.plans import answer, catalogue
from marlstone.plans import policy as P
from marlstone.sources import files

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    if hasattr(v, "to_eng_string"):
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return c


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, str(DATA))
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = duck.sql(catalogue.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert got == sorted((tuple(_norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


def test_files_to_answers(spark, tmp_path):
    src = tmp_path / "corpus"
    src.mkdir()
    (src / "answer.txt").write_text("The harbour light is painted green, which one line is enough to say.\n")
    (src / "guide.md").write_text("# Notes\n\nA boat needs a coat of paint every spring.\n")
    (src / "policy.html").write_text("<h1>Policy</h1><p>Dogs stay on the quay.</p>")
    (src / "message.eml").write_text("From: a@example.com\nTo: b@example.com\nSubject: x\n\nThe ferry is late.\n")
    (src / "example.py").write_text('"""Doc."""\nVALUE = 1\n')
    (tmp_path / "p.toml").write_text('[indexing]\nstrategy = "hybrid"\n[chunking]\nmin_chunk_chars = 1\n')
    profile = files.load_profile(tmp_path / "p.toml")
    n = answer.index(spark, profile, str(tmp_path / "store"), str(src))
    chunks = answer.Store(spark, str(tmp_path / "store")).rows(P.manifest(str(src), profile))
    assert n >= 5 and chunks.select("uri").distinct().count() == 5
    said, found = answer.ask(chunks, spark.createDataFrame([(0, "Which colour is the harbour light?")], "query_id long, query string"), profile)
    assert found.where("rank = 1").first().uri.endswith("answer.txt")
    assert said.first().answer.startswith("The harbour light is painted green,")
    (tmp_path / "e.jsonl").write_text(json.dumps({"example_id": "e", "query": "harbour light", "expected_answer": "PAINTED green"}) + "\n")
    got = answer.evaluate(chunks, files.read_examples(spark, str(tmp_path / "e.jsonl")), profile).collect()
    assert [(r.metric, r.value) for r in got] == [("answer_contains_expected", 1.0)]


def test_sources_refuse(spark, tmp_path):
    with pytest.raises(ValueError):
        files.local_path("https://example.com/a")
    (tmp_path / "a.txt").write_text("")
    with pytest.raises(ValueError, match="empty"):
        files.scan_files(spark, str(tmp_path))
    (tmp_path / "a.txt").write_text("x")
    with pytest.raises(OverflowError):
        files.scan_files(spark, str(tmp_path), most_bytes=0)
    (tmp_path / "l").symlink_to(tmp_path / "a.txt")
    with pytest.raises(ValueError, match="links"):
        files.scan_files(spark, str(tmp_path))
    (tmp_path / "bad.toml").write_text("[chunking]\nnope = 1\n")
    with pytest.raises(ValueError, match="unknown field"):
        files.load_profile(tmp_path / "bad.toml")
    (tmp_path / "bad.jsonl").write_text('{"example_id": "a"}\n')
    with pytest.raises(ValueError):
        files.read_examples(spark, str(tmp_path / "bad.jsonl"))


def test_policies():
    assert P.indexing() == {"strategy": "dense", "vector_database": "in_memory", "physical_index": "exact"}
    assert P.indexing("hybrid", "pgvector", "hnsw")["physical_index"] == "hnsw"
    for bad in (("sparse", "sqlite"), ("dense", "nope"), ("dense", "qdrant", "exact"), ("odd",)):
        with pytest.raises(ValueError):
            P.indexing(*bad)
    with pytest.raises(LookupError):
        P.PORTS["chunker"].create("none")
    assert "program:tesseract" in P.capabilities()
    t = P.Telemetry()
    with t.stage("chunk", n=3):
        pass
    assert t.events[0]["attributes"] == {"ok": True, "n": 3}
    with pytest.raises(ValueError):
        t.record("x", 0, 1, password="p")
    with pytest.raises(ValueError):
        t.record("x", 2, 1)


def test_stream_index(spark, tmp_path):
    from marlstone.operators.store import MANIFEST_FIELDS, Store
    from marlstone.streaming.incremental import index_stream

    src, m = tmp_path / "in", {f: 1 for f in MANIFEST_FIELDS}
    spark.createDataFrame([("a", "1"), ("b", "2")], "chunk_id string, text string").write.parquet(str(src))
    store = Store(spark, str(tmp_path / "s"))
    read = lambda: spark.readStream.schema("chunk_id string, text string").parquet(str(src))
    index_stream(read(), store, m, str(tmp_path / "c")).awaitTermination()
    spark.createDataFrame([("b", "3")], "chunk_id string, text string").write.mode("append").parquet(str(src))
    index_stream(read(), store, m, str(tmp_path / "c")).awaitTermination()
    assert {tuple(r) for r in store.rows(m).collect()} == {("a", "1"), ("b", "3")}
