"""Each stage of the pipeline against brute force on its own input."""

import re
from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline as P
from marlstone.llm.mixing import quotas

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables aren't here")


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The output of every stage, written and read again as the driver does."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    out["input"] = docs
    for name, stage in P.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, DATA).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_shape(steps):
    names = [n for n, _ in P.STAGES]
    assert names == ["quality", "repeated_lines", "near_copies", "mixing", "packing"]
    for n in names[:-1]:
        assert steps[n].columns == steps["input"].columns and steps[n].count() > 0


def test_quality(spark, steps):
    kept = {r.doc_id for r in steps["quality"].collect()}
    lab = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    good, bad = {r.doc_id for r in lab if r.quality == 1}, {r.doc_id for r in lab if r.quality == 0}
    assert len(kept & good) >= 0.95 * len(good) and len(kept & bad) <= 0.2 * len(bad)


def test_lines(steps):
    seen, want = set(), {}
    for r in sorted(steps["quality"].collect(), key=lambda r: r.doc_id):
        keep = []
        for line in r.text.split("\n"):
            s = line.strip(" ")
            if not s or s not in seen:
                keep.append(line)
            seen.add(s)
        text = "\n".join(keep)
        if text.strip(" ") or text == r.text:
            want[r.doc_id] = (text, len(text))
    assert {r.doc_id: (r.text, r.n_chars) for r in steps["repeated_lines"].collect()} == want


def test_copies(steps):
    sets = {}
    for r in steps["repeated_lines"].collect():
        w = re.findall(r"[^\W_]+", r.text.lower())
        if w:
            sets[r.doc_id] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    gone = {i for i in sets if find(i) != i}
    before = {r.doc_id for r in steps["repeated_lines"].collect()}
    assert {r.doc_id for r in steps["near_copies"].collect()} == before - gone


def test_mixing(steps):
    have = Counter(r.source for r in steps["near_copies"].collect())
    got = Counter(r.source for r in steps["mixing"].collect())
    assert got == Counter(quotas(have))


def test_packing(steps):
    docs = {r.doc_id: len(r.text.split()) for r in steps["mixing"].collect()}
    use, room = Counter(), Counter()
    for r in steps["packing"].collect():
        use[r.doc_id] += r.n_tokens
        room[r.window_id] += r.n_tokens
    assert dict(use) == {d: n for d, n in docs.items() if n} and max(room.values()) <= 4096


def test_run(spark, steps):
    assert sorted(map(tuple, P.run(spark, DATA).collect())) == sorted(map(tuple, steps["packing"].collect()))


def test_copies_of_a_large_class(spark, monkeypatch):
    """A large class of near copies leaves one document, and its pairs don't come from the shards."""
    from conftest_llm import make_docs, words

    from marlstone.llm import common as C

    base, found, table = words(80, 1, 10**6).split(), {}, C.table
    rows = [(i, " ".join(base[: i % 80] + [f"e{i}"] + base[i % 80 + 1 :])) for i in range(150)] + [(1000 + i, words(40, 9 + i)) for i in range(10)]

    def kept(df, name, *more, **by):
        found[name] = table(df, name, *more, **by)
        return found[name]

    monkeypatch.setattr(C, "table", kept)
    got = {r.doc_id for r in P.near_copies(spark, make_docs(spark, rows), DATA).collect()}
    assert got == {0, *range(1000, 1010)}
    assert found["ngram-candidates"].count() < 1000
