"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing columns: a defined result, the same with and without further columns."""

import pytest
from conftest_llm import rows_of

from marlstone.llm.exact_dedup import exact_dedup
from marlstone.llm.line_dedup import dedup_lines
from marlstone.llm.mixing import mix, mixed_documents
from marlstone.llm.ngram_join import ngram_jaccard_join
from marlstone.llm.packing import pack_documents
from marlstone.llm.permutation_ann import nearest_neighbours
from marlstone.llm.pii import find_pii
from marlstone.llm.quality_fm import fit_quality, keep_quality, score_quality
from marlstone.llm.secret_scan import scan_secrets
from marlstone.llm.toxicity import fit_toxicity, score_toxicity

OPS = {
    "ngram": lambda d, lab: ngram_jaccard_join(d),
    "exact": lambda d, lab: exact_dedup(d),
    "toxicity": lambda d, lab: score_toxicity(d, fit_toxicity(d, lab)),
    "pii": lambda d, lab: find_pii(d),
    "packing": lambda d, lab: pack_documents(d, capacity=256),
    "lines": lambda d, lab: dedup_lines(d).select("doc_id", "text", "n_lines", "n_removed"),
    "secrets": lambda d, lab: scan_secrets(d),
    "mixing": lambda d, lab: mix(d, shard_docs=3),
    "mixed": lambda d, lab: mixed_documents(d, shard_docs=3).select("doc_id", "text"),
    "quality": lambda d, lab: score_quality(d, fit_quality(d, lab)),
    "kept": lambda d, lab: keep_quality(d, fit_quality(d, lab)).select("doc_id", "text"),
}


@pytest.mark.parametrize("name", OPS)
def test_edges(edge_docs, clashing, labels, name):
    plain = rows_of(OPS[name](edge_docs, labels))
    assert rows_of(OPS[name](clashing, labels)) == plain
    assert rows_of(OPS[name](edge_docs.repartition(5), labels.repartition(3))) == plain


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(edge_docs, labels, name):
    assert rows_of(OPS[name](edge_docs.limit(0), labels.limit(0))) == []


def test_defined_results(spark, edge_docs, labels):
    classes = {tuple(r) for r in ngram_jaccard_join(edge_docs).collect()}
    assert classes == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 0), (5, 4, 0), (6, 6, 1), (7, 6, 1), (8, 6, 1), (9, 9, 0), (10, 10, 0), (11, 10, 0), (12, 12, 0), (13, 13, 0)}
    canon = {(r.doc_id, r.canonical_id) for r in exact_dedup(edge_docs).collect()}
    assert canon == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10), (11, 10), (12, 12), (13, 13)}
    assert {r.doc_id for r in score_toxicity(edge_docs, None).collect() if r.toxic} == set()
    assert {r.doc_id for r in score_quality(edge_docs, None).collect() if not r.keep} == {1, 2, 3, None}
    lines = {r.doc_id: r for r in dedup_lines(edge_docs).where("doc_id IS NOT NULL").collect()}
    assert lines[1].text is None and lines[1].n_lines == 0 and lines[2].text == "" and lines[3].text == "   \n \n"
    assert lines[5].text == "" and lines[4].n_removed == 0 and lines[11].text == "" and lines[12].text.endswith("line")
    assert lines[12].n_removed == 1
    packed = {r.doc_id for r in pack_documents(edge_docs, 256).collect()}
    assert packed == {4, 5, 6, 7, 8, 9, 10, 11, 12, 13}
    drawn = {r.doc_id for r in mix(edge_docs, weights={"s0": 1.0}).collect()}
    assert drawn == set(range(1, 14)) and mix(edge_docs, weights={"none": 1.0}).count() == 0


def test_vectors(spark):
    v = [(i, [float(i % 5), 1.0, float(i)], i) for i in range(20)]
    odd = [(20, None, 0), (21, [0.0, 0.0, 0.0], 0), (22, [1.0], 0), (None, [1.0, 2.0, 3.0], 0), (23, [1.0, None, 2.0], 0), (24, [float("nan"), 1.0, 1.0], 0), (0, [0.0, 1.0, 0.0], 0)]
    df = spark.createDataFrame(v + odd, "vec_id long, embedding array<double>, v int")
    got = nearest_neighbours(df, k=3, every=1).collect()
    assert {r.vec_id for r in got} == set(range(20)) and all(r.neighbour_id < 20 and r.neighbour_id != r.vec_id for r in got)
    assert len(got) == 60 and nearest_neighbours(df.limit(0), every=1).count() == 0
    assert {r.vec_id for r in nearest_neighbours(df, k=3).collect()} == {0} and nearest_neighbours(df.where("vec_id % 100 > 0")).count() == 0
    clash = df.selectExpr("*", "1 AS file", "2 AS part", "3 AS query", "4 AS q", "5 AS sim")
    assert rows_of(nearest_neighbours(clash, k=3, every=1)) == sorted(map(tuple, got), key=repr)
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.rank, r.neighbour_id) for r in nearest_neighbours(same, k=2, every=1).collect())[:2] == [(0, 1, 1), (0, 2, 2)]
    assert nearest_neighbours(same.limit(1), every=1).count() == 0
