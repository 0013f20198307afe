"""What must not grow faster than the input: chunks are counted, embedded, scored and cut in the batch
where they lie, and what is handed on is bounded."""

import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions import spans as S
from marlstone.functions.batches import Best
from marlstone.operators import chunking as C
from marlstone.operators import retrieval as R
from marlstone.plans import catalogue as K

WORDS = [f"w{i}" for i in range(60)]


def _texts(n=120, seed=0):
    r = random.Random(seed)
    made = [" ".join(r.choices(WORDS, k=r.randrange(0, 30))) for _ in range(n)]
    return made + made[: n // 3] + [None, "", "x_y Straße"]  # copies tie


def _chunks(spark, texts=None):
    return spark.createDataFrame(list(enumerate(texts or _texts())), "chunk_id long, text string").repartition(3)


def _queries(spark, n=25):
    r = random.Random(1)
    return spark.createDataFrame([(100 + i, " ".join(r.choices(WORDS, k=5))) for i in range(n)] + [(7, "strasse"), (8, "?")], "query_id long, query string")



def _rows(df):
    return sorted(tuple(r) for r in df.collect())


# --- F5, F6, F9: cutting ------------------------------------------------------------------------


@pytest.mark.parametrize("strategy", ["hierarchical", "legal", "code"])
def test_a_batch_of_parts_is_cut_in_portions(strategy):
    head = {"hierarchical": "# Part\n\n## Line\n\n", "legal": "Section 1.1 Terms\n\n", "code": "def part():\n    "}[strategy]
    texts = ["\n\n".join(f"{head}line {i} of {j}" for i in range(40)) for j in range(50)]
    policy = S.Policy(strategy, max_chars=200, overlap_chars=20)
    cut = lambda doc, part, order, text, start: ((doc, part, order, i, start + lo, start + hi, text[lo:hi], path, None) for i, (lo, hi, path) in enumerate(S.spans(text, policy, part)))
    batch = pa.RecordBatch.from_arrays([pa.array([str(j) for j in range(50)]), pa.array(["p"] * 50), pa.array([0] * 50, pa.int32()), pa.array(texts), pa.array([0] * 50, pa.int32())], names=["d", "p", "o", "t", "s"])
    out = list(C._cutter(cut, 10_000)(iter([batch])))
    assert len(out) > 3 and max(b.nbytes for b in out) < 200_000
    got = [(r["document_id"], r["start"], r["end"]) for b in out for r in b.to_pylist()]
    assert got == [(str(j), lo, hi) for j, t in enumerate(texts) for lo, hi, _ in S.spans(t, policy, "p")]


# --- F19, F20: postings and embeddings -----------------------------------------------------------


def test_postings_are_counted_without_a_shuffle(spark):
    texts = _texts()
    p = R.postings(_chunks(spark, texts).coalesce(1))
    want = sorted((t, i, len(ts), n) for i, x in enumerate(texts) for ts in [re.findall(r"[^\W_]+", (x or "").casefold())] for t, n in Counter(ts).items())
    assert _rows(p.select("term", "chunk_id", "dl", "tf")) == want
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    assert "Exchange" not in R.postings(rows)._jdf.queryExecution().executedPlan().toString()


def test_postings_of_repeated_ids_are_counted_together(spark):
    rows = spark.createDataFrame([(1, "a b"), (1, "a c"), (2, "a")], "chunk_id long, text string")
    assert _rows(R.postings(rows).select("term", "chunk_id", "tf")) == [("a", 1, 2), ("a", 2, 1), ("b", 1, 1), ("c", 1, 1)]
    cells = {(r.chunk_id, r.i): r.value for r in R.hash_embedding_cells(rows, 64).collect()}
    whole = {(r.chunk_id, r.i): r.value for r in R.hash_embedding_cells(spark.createDataFrame([(1, "a b a c"), (2, "a")], "chunk_id long, text string"), 64).collect()}
    assert cells == whole


def test_embeddings_are_made_without_a_shuffle(spark):
    texts, dim = _texts(), 16
    rows = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    cells = R.hash_embedding_cells(rows, dim)
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    want = {}
    for n, text in enumerate(texts):
        x = [0.0] * dim
        for t in re.findall(r"\w+", (text or "").casefold()):
            h = hashlib.sha256(t.encode()).hexdigest()
            x[int(h[:8], 16) % dim] += 1.0 if int(h[8:10], 16) % 2 else -1.0
        norm = sum(v * v for v in x) ** 0.5
        want |= {(n, i): v / norm for i, v in enumerate(x) if v} if norm else {(n, 0): 1.0}
    assert {(r.chunk_id, r.i): r.value for r in cells.collect()} == want


# --- F1, F3, F4, F7, F8, F14, F18: search --------------------------------------------------------


def _shuffled(df):
    """Exchanges of a plan, each node once."""
    return len(re.findall(r"^[\s:+\-*()\d]*Exchange ", df._jdf.queryExecution().executedPlan().toString(), re.M))


@pytest.mark.parametrize("k", [1, 4, 500])
def test_bm25_hands_on_k_of_each_query(spark, k):
    c, q = _chunks(spark), _queries(spark)
    got = R.bm25(c, q, k)
    assert _shuffled(got) == 1  # for the k best; what chunks hold of the terms isn't sent
    assert _rows(got.select("query_id", "chunk_id", "relevance", "rank")) == _rows(R.top_k(R.bm25(c, q), k).select("query_id", "chunk_id", "relevance", "rank"))


def test_bm25_of_more_terms_than_are_scored_in_place(spark, monkeypatch):
    c, q = _chunks(spark), _queries(spark)
    want = _rows(R.bm25(c, q, 3).select("query_id", "chunk_id", "relevance", "rank"))
    monkeypatch.setattr(R, "LOCAL_TERMS", 4)
    assert _rows(R.bm25(c, q, 3).select("query_id", "chunk_id", "relevance", "rank")) == want


def test_bm25_of_names_and_of_nothing(spark):
    c = _chunks(spark).select(F.concat(F.lit("chk-"), "chunk_id").alias("chunk_id"), "text")
    q = _queries(spark).select(F.concat(F.lit("q"), "query_id").alias("query_id"), "query")
    cols = ("query_id", "chunk_id", "relevance", "rank")
    assert _rows(R.bm25(c, q, 3).select(*cols)) == _rows(R.top_k(R.bm25(c, q), 3).select(*cols))
    assert R.bm25(c.limit(0), q, 3).count() == 0 and R.bm25(c, q.where("query = '?'"), 3).count() == 0
    twice = c.union(c.limit(5))
    assert _rows(R.bm25(twice, q, 3).select(*cols)) == _rows(R.top_k(R.bm25(twice, q), 3).select(*cols))


def test_nearest_by_hash_sends_no_vectors(spark, monkeypatch):
    c, q = _chunks(spark), _queries(spark)
    cols = ("query_id", "chunk_id", "relevance", "rank")
    near = R.hash_nearest(c, q, 7, 32)
    assert _shuffled(near) == 1 + 1  # the k best, and this table's own repartition
    got = _rows(near.select(*cols))
    monkeypatch.setattr(R, "LOCAL_QUERIES", 2)
    assert got == _rows(R.hash_nearest(c, q, 7, 32).select(*cols)) and len(got) == 27 * 7


def test_best_keeps_ties_by_id():
    import numpy as np

    r, best, every = np.random.default_rng(0), Best(1, 5), []
    for lo in range(0, 300, 30):
        ids, s = r.permutation(np.arange(lo, lo + 30)), r.integers(0, 3, 30) / 2
        every += zip((-s).tolist(), ids.tolist())
        best.offer(0, ids, s, np.arange(30))
    assert [(-s, i) for s, i in sorted(every)[:5]] == [(s, i) for b in best.batches(pa.array([9]), pa.int64()) for i, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]


# --- F2, F10 to F13, F15 to F17: answers and evaluation -------------------------------------------


@pytest.fixture
def tables(spark, tmp_path):
    texts = [t for t in _texts() if t is not None]
    passages = [t[3 : 3 + 40] for t in texts if len(t) > 60][:30] + ["w1", "no such passage at all here"]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), texts, passages


def test_gold_needs_no_whole_index(spark, tables, monkeypatch):
    d, texts, passages = tables
    monkeypatch.setattr(K, "_index", lambda *a: pytest.fail("the whole index was written"))
    got = {r.query_id: sorted(r.relevant) for r in K._gold(spark, d).collect()}
    assert got == {i: at for i, p in enumerate(passages) if (at := [j for j, t in enumerate(texts) if p in t])}
    for f in (K.eval_case_metrics, K.eval_family_means, K.eval_thresholds, K.answer_metrics):
        assert f(spark, d).count() > 0


def test_gold_of_a_batch_too_large_to_count(spark, tables, monkeypatch):
    d, texts, passages = tables
    monkeypatch.setattr(R, "LOCAL_TERMS", 4)
    got = {r.query_id: sorted(r.relevant) for r in K._gold(spark, d).collect()}
    assert got == {i: at for i, p in enumerate(passages) if (at := [j for j, t in enumerate(texts) if p in t])}


@pytest.mark.parametrize("f", [K.prompt_budget, K.prompt_render, K.extractive_answer, K.citations, K.answer_metrics, K.eval_thresholds])
def test_what_was_found_is_not_found_again(spark, tables, f):
    """The plan reads what was found; no text is counted or scored again for each of its uses."""
    plan = f(spark, tables[0])._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan


def test_counts_follow_the_files(spark, tables):
    d, texts, _ = tables
    q = spark.createDataFrame([(0, "w1 w2")], "query_id long, query string")
    first = K._lexical(spark, d, q)
    assert K._lexical(spark, d, q) is first and first.n == len(texts)
    spark.createDataFrame([(10_000, "w1", "en", "s", 2)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("append").parquet(f"{d}/documents.parquet")
    assert K._lexical(spark, d, q).n == len(texts) + 1
