"""Whole operators without SQL against slow versions that say the same one step at a time."""

import io
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import edge_rows, make_docs, rows_of, words
from pyspark.sql import functions as F

from marlstone.llm import common as C
from marlstone.llm import packing, pii
from marlstone.llm import quality_fm as Q
from marlstone.llm import secret_scan as X
from marlstone.llm import toxicity as T
from marlstone.llm.mixing import BUCKET_DOCS, SEED, SplitTree, mix, mixed_documents, quotas


def some_docs(n=40, seed=0):
    """Good, junk and toxic texts of several sizes, with the edge cases."""
    rng = np.random.default_rng(seed)
    bad = ["zorb", "grukked", "grukking", "vlim"]
    out = []
    for i in range(n):
        w = words(int(rng.integers(1, 60)), i, 300).split()
        if i % 3 == 0:
            for _ in range(int(rng.integers(1, 6))):
                w.insert(int(rng.integers(len(w) + 1)), bad[int(rng.integers(4))])
        if i % 4 == 1:
            w = ["buy", "NOW!!!", "|||", "$$$"] * 5 + w[:3]
        out.append((i, " ".join(w) + ("\n" if i % 5 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}"))
    return out + [(100, None), (101, ""), (102, " \n"), (103, "ünïcode ßtraße 中文 12,5"), (103, "again"), (104, words(5000, 9))]


# --- words ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("limit", [None, 50, 7])
def test_words_one_at_a_time(limit):
    texts = [r[1] for r in some_docs()] + ["x" * 300, "_a_b1 ß ﬁ Ⅷ ²", "end", None]
    ends, h, heads = C.word_hashes(iter(texts), (2, 5), limit)
    at = 0
    for t, end in zip(texts, ends.tolist(), strict=True):
        tokens = re.findall(r"[^\W_]+", (t or "").lower())
        assert h[at:end].tolist() == [C.word_hash(w) for w in tokens]
        for k in (2, 5):
            assert heads[k][at:end].tolist() == [C.word_hash(w[:k]) if len(w) >= k else 0 for w in tokens]
        at = end
    assert at == len(h) and C.word_hashes([])[0].tolist() == []
    for n in (1, 3):
        for t, g in zip(texts, C.ngram_sets(texts, n), strict=True):
            tokens = re.findall(r"[^\W_]+", (t or "").lower())
            assert len(g) == len({tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))} - {()}) and (np.diff(g.astype(object)) > 0).all()


# --- toxicity -----------------------------------------------------------------------------------


def _slots(text):
    n = Counter()
    for w in {x for x in re.findall(r"[^\W_]+", (text or "").lower())}:
        n.update(set(T.slots_of(w)))
    return {s: math.log2(1 + k) for s, k in n.items()}


def test_toxicity_one_document_at_a_time(spark):
    rows = some_docs()
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = make_docs(spark, rows)
    blob = T.fit_toxicity(docs, labels)
    z = np.load(io.BytesIO(blob))
    w, theta = z["w"].astype(float), z["theta"]
    assert np.count_nonzero(w) and (np.diff(theta) > 0).all()
    want = []
    for i, text, *_ in rows:
        f = _slots(text)
        above = [1 / (1 + math.exp(-(sum(w[s] * v for s, v in f.items()) - t))) for t in theta] if f else [0.0] * len(theta)
        want.append((i, round(sum(above), 9), sum(p >= 0.5 for p in above), any(p >= 0.5 for p in above)))
    got = [(r.doc_id, round(r.expected_severity, 9), r.grade, r.toxic) for r in T.score_toxicity(docs, blob).collect()]
    assert sorted(got) == sorted(want) and {g[2] for g in got} >= {0, 1}


def test_ordinal_fit_is_a_minimum():
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, 90)
    rows = [(s := np.unique(np.concatenate([rng.integers(50, 80, 4), np.arange(k * 4)])), np.ones(len(s))) for k in y]
    ridge, balance = 2.0, 0.5
    m = T.CumulativeLink.fit(rows, y.tolist(), ridge=ridge, balance=balance)
    n, pos = len(y), y > 0
    mass = np.where(pos, (n / (2 * pos.sum())) ** balance, (n / (2 * (~pos).sum())) ** balance)

    def loss(w, theta):
        total = 0.0
        for (idx, val), k, weight in zip(rows, y, mass):
            cut = [-math.inf, *theta, math.inf]
            score = sum(w[i] * v for i, v in zip(idx, val))
            below = lambda t: 0.0 if t == -math.inf else 1.0 if t == math.inf else 1 / (1 + math.exp(-(t - score)))
            total -= weight * math.log(below(cut[k + 1]) - below(cut[k]))
        return total / n + ridge / n / 2 * float(w @ w)

    best = loss(m.w, m.theta)
    for i, step in itertools.product([*np.flatnonzero(m.w)], (-0.1, 0.1)):
        w = m.w.copy()
        w[i] += step
        assert loss(w, m.theta) >= best - 1e-5
    for j, step in itertools.product(range(len(m.theta)), (-0.1, 0.1)):
        theta = m.theta.copy()
        theta[j] += step
        assert loss(m.w, theta) >= best - 1e-5


# --- quality ------------------------------------------------------------------------------------


def _features(text, lang, source):
    text = text or ""
    tokens = re.findall(r"[^\W_]+", text.lower())
    tf = Counter(C.word_hash(t) & ((1 << Q.WORD_BITS) - 1) for t in tokens)
    norm = math.sqrt(sum(math.log1p(k) ** 2 for k in tf.values())) or 1.0
    out = {s: math.log1p(k) / norm for s, k in tf.items()}
    n = max(len(text), 1)
    plain = set(".,;:'\"!?()-|")
    size = len(text.encode())
    stats = [
        sum(ord(c) < 128 and ord(c) > 32 and not c.isalnum() and c not in plain for c in text) / n,
        sum("A" <= c <= "Z" for c in text) / max(1, size - text.count(" ")),
        sum("0" <= c <= "9" for c in text) / n,
        text.count(" ") / n,
        n / max(1, len(tokens)),
        len(set(tokens)) / max(1, len(tokens)),
        sum(a == b for a, b in zip(tokens, tokens[1:])) / (len(tokens) - 1) if len(tokens) > 1 else 0.0,
        text.count("!") / n,
        text.count("|") / n,
        n / (1 + text.count("\n")),
        n,
    ]
    for i, (cuts, v) in enumerate(zip(Q._CUTS.values(), stats)):
        out[Q.STRUCT0 + 16 * i + sum(c < v for c in cuts)] = 0.5
    for k, v in (("lang", lang), ("source", source)):
        out[Q.META0 + zlib.crc32(f"{k}={v}".encode()) % (1 << Q.META_BITS)] = 0.2
    return out


def test_quality_one_pair_of_features_at_a_time(spark):
    rows = [(r[0], r[1], *(r[2:] or ("en", "s0"))) for r in some_docs()] + [(105, "no language", None, None)]
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(40)], "doc_id long, quality int")
    docs = make_docs(spark, rows)
    blob = Q.fit_quality(docs, labels)
    z = np.load(io.BytesIO(blob))
    w0, w, v = float(z["w0"]), z["w"].astype(float), z["v"].astype(float)
    want = []
    for i, text, lang, source in rows:
        f = list(_features(text, lang, source).items())
        score = w0 + sum(w[s] * x for s, x in f) + sum(v[s] @ v[t] * x * y for k, (s, x) in enumerate(f) for t, y in f[:k])
        p = 1 / (1 + math.exp(-score))
        want.append((i, round(p, 4), bool(text and text.strip()) and p >= Q.KEEP))
    got = [(r.doc_id, round(r.quality, 4), r.keep) for r in Q.score_quality(docs, blob).collect()]
    assert [g[0::2] for g in sorted(got)] == [g[0::2] for g in sorted(want)] and {g[2] for g in got} == {True, False}
    assert max(abs(a[1] - b[1]) for a, b in zip(sorted(got), sorted(want))) < 2e-4
    kept = Q.keep_quality(docs, blob)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(g[0] for g in want if g[2]) and kept.columns == docs.columns


# --- personal data --------------------------------------------------------------------------------


def test_pii_one_span_at_a_time(spark):
    said = ["mail a.b@mail.example.com now", "call +1 (319) 555-5132 or", "from 45.196.222.209 at", "card 4279055890764913 ok", "version 300.1.2.999 of", "order 1234567 of", "a@b broken", "ssn 078-05-1120 here", "isbn 978 3 16 148410 0 book"]
    rows = [(i, f"{words(6, i)} {said[i % len(said)]} {words(4, i + 1)}") for i in range(45)] + [(900, None), (901, ""), (902, "nothing")]
    items = []
    for i, t in rows:
        for s, e, kind in pii.candidates(t):
            before, after = t[max(0, s - pii.CONTEXT) : s], t[e : e + pii.CONTEXT]
            v = pii.votes(kind, t[s:e], before, after)
            items.append(((i, s, e, kind), v, pii.features(kind, t[s:e], before, after, v)))
    # expectation-maximisation over single spans
    n, k, trust = len(items), len(pii.VOTERS), 0.25
    post = [1 / (1 + math.exp(-sum(v))) for _, v, _ in items]
    prior = ({-1: 0.5, 0: 0.4, 1: 0.1}, {-1: 0.1, 0: 0.4, 1: 0.5})
    for _ in range(50):
        table = [[{x: prior[t][x] * trust * n + sum((p if t else 1 - p) for p, (_, v, _) in zip(post, items) if v[j] == x) for x in (-1, 0, 1)} for j in range(k)] for t in (0, 1)]
        table = [[{x: d[x] / sum(d.values()) for x in d} for d in voters] for voters in table]
        share = [(sum((p if t else 1 - p) for p in post) + trust * n / 2) / (n * (1 + trust)) for t in (0, 1)]
        post = []
        for _, v, _ in items:
            ll = [math.log(share[t]) + sum(math.log(table[t][j][v[j]]) for j in range(k)) for t in (0, 1)]
            post.append(1 / (1 + math.exp(ll[0] - ll[1])))
    # logistic regression on dense rows
    x = np.zeros((n, 1 << pii.FEATURE_BITS))
    for r, (_, _, f) in enumerate(items):
        x[r, f] = 1
    w, m1, m2 = (np.zeros(x.shape[1]) for _ in range(3))
    for t in range(1, 201):
        g = x.T @ (1 / (1 + np.exp(-x @ w)) - np.array(post)) / n + 1e-4 * w
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        w -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    p = 1 / (1 + np.exp(-x @ w))
    want = {(*at, round(float(q), 6)) for (at, _, _), q in zip(items, p) if q >= pii.ACCEPT}
    got = {(*tuple(r)[:4], round(r.score, 6)) for r in pii.find_pii(make_docs(spark, rows)).collect()}
    assert got == want and 15 <= len(want) < len(items)


# --- packing --------------------------------------------------------------------------------------


def _merge_by_hand(sizes, windows):
    """Largest differencing by looking at all partitions each time."""
    parts = [(k, [[s, [i]]] + [[0, []] for _ in range(windows - 1)]) for k, (i, s) in enumerate(sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])))]
    made = len(parts)
    while len(parts) > 1:
        worth = lambda p: (-(p[1][0][0] - p[1][-1][0]) if windows > 1 else 0, p[0])
        parts.sort(key=worth)
        (_, a), (_, b) = parts[:2]
        both = [[x[0] + y[0], x[1] + y[1]] for x, y in zip(a, reversed(b))]
        both.sort(key=lambda x: -x[0])
        low = both[-1][0]
        parts = [*parts[2:], (made, [[x[0] - low, x[1]] for x in both])]
        made += 1
    return [sorted(m) for _, m in parts[0][1]]


def test_differencing_by_hand():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes, windows = rng.integers(1, 60, rng.integers(1, 25)).tolist(), int(rng.integers(1, 7))
        assert sorted(sorted(p) for p in packing.differencing(np.array(sizes), windows)) == sorted(_merge_by_hand(sizes, windows))


def test_packing_by_hand(spark):
    rows = [(i, words(1 + (i * 29) % 90, i)) for i in range(60)] + [(7, "again and again"), (7, "again and again"), (70, words(501, 3)), (71, None), (72, " \n"), (73, "a b c　d\x1ce"), (None, "lost")]
    pieces = sorted((i, s, min(100, n - s)) for i, t in rows if i is not None and t for n in [len(t.split())] for s in range(0, n, 100))
    total = sum(p[2] for p in pieces)
    windows = math.ceil(total / 100)
    while True:
        parts = _merge_by_hand([p[2] for p in pieces], windows)
        if max(sum(pieces[i][2] for i in p) for p in parts) <= 100:
            break
        windows += 1
    want = Counter(tuple((pieces[i], off) for i, off in zip(p, itertools.accumulate([0, *(pieces[i][2] for i in p)]))) for p in parts if p)
    got = defaultdict(list)
    for r in packing.pack_documents(make_docs(spark, rows), capacity=100, block_windows=10**6).collect():
        got[r.window_id].append(((r.doc_id, r.start_token, r.n_tokens), r.window_offset))
    assert Counter(tuple(sorted(v, key=lambda x: x[1])) for v in got.values()) == want
    assert {p[0][0]: p[0][2] for v in got.values() for p in v if p[0][0] == 73} == {73: 5}


def test_packing_waste_is_small_at_every_size(spark):
    for n, length, waste in ((3000, 6, 1.04), (300, 60, 1.15)):
        rows = [(i, words(1 + (i * 7) % (2 * length), i)) for i in range(n)]
        got = packing.pack_documents(make_docs(spark, rows), capacity=128, block_windows=16).groupBy("window_id").agg(F.sum("n_tokens").alias("n")).collect()
        assert sum(r.n for r in got) == sum(len(t.split()) for _, t in rows) and max(r.n for r in got) <= 128
        assert len(got) <= waste * math.ceil(sum(r.n for r in got) / 128)


# --- mixing -----------------------------------------------------------------------------------------


def _walk(quota, lo, hi, seed, out):
    """The tree, a node at a time: shard -> blocks of each source."""
    if hi - lo == 1:
        out[lo] = quota
        return
    mid = (lo + hi) // 2
    take = sum(quota) * (mid - lo) // (hi - lo)
    left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(quota, take, method="marginals").tolist()
    _walk(left, lo, mid, seed, out)
    _walk([q - x for q, x in zip(quota, left)], mid, hi, seed, out)


@pytest.mark.parametrize("block", [None, 7])
def test_mixing_by_hand(spark, block):
    rows = [(i, "t", "en", "hot" if i % 3 else f"s{i % 5}") for i in range(400)] + [(5, "other text", "en", "hot"), (500, None, "en", None), (501, "", None, "s0"), (None, "x", "en", "s0")]
    docs = make_docs(spark, rows)
    pairs = sorted({(r[0], r[3] or "") for r in rows if r[0] is not None})
    hashed = spark.createDataFrame(pairs, "doc_id long, source string").select("doc_id", "source", F.xxhash64(F.lit(SEED), "source", "doc_id").alias("h"), F.xxhash64(F.lit(SEED + 1), "source", "doc_id").alias("p")).collect()
    q = quotas(Counter(s for _, s in pairs))
    names, size = sorted(q), block or 1
    shards = max(1, math.ceil(sum(q.values()) / 40))
    leaves: dict = {}
    _walk([-(-q[s] // size) for s in names], 0, shards, SEED, leaves)
    bits = max(0, math.ceil(math.log2(max(Counter(r.source for r in hashed).values()) / BUCKET_DOCS + 1)))
    signed = lambda x: (x & (2**64 - 1)) - (x >> 63 & 1) * 2**64
    want = []
    for j, s in enumerate(names):
        # the permutation: buckets by the leading bits of the hash, inside by the others, then doc_id
        order = sorted((r for r in hashed if r.source == s), key=lambda r: ((r.h & (2**64 - 1)) >> (64 - bits), signed(r.h << bits), r.doc_id))
        shard_of = [shard for shard in range(shards) for _ in range(leaves[shard][j] * size)]
        want += [(r.doc_id, s, shard_of[k], r.p) for k, r in enumerate(order[: q[s]])]
    ranked = []
    for shard in range(shards):
        ranked += [(d, s, shard, k + 1) for k, (_, d, s) in enumerate(sorted((p, d, s) for d, s, x, p in want if x == shard))]
    assert rows_of(mix(docs, shard_docs=40, block=block)) == sorted(ranked, key=repr)
    assert Counter(r[1] for r in ranked) == Counter(q)
    drawn = {(d, s) for d, s, _, _ in ranked}
    assert rows_of(mixed_documents(docs, shard_docs=40, block=block)) == sorted(((r[0], r[1], r[2], r[3], len(r[1]) if r[1] is not None else None) for r in rows if (r[0], r[3] or "") in drawn), key=repr)


def test_tasks_draw_only_their_part_of_the_tree():
    tree = SplitTree([10**7, 3 * 10**6], 2**20)
    got = tree.shards_of(np.array([0, 0, 1]), np.array([0, 1, 2_999_999]))
    assert got[0] == got[1] == 0 and got[2] >= 2**20 - 5 and len(tree._left) < 60
    small = SplitTree([50, 13, 0], 9)
    ends = small.leaves().cumsum(0)
    for j, n in enumerate((50, 13)):
        assert small.shards_of(np.full(n, j), np.arange(n)).tolist() == [int(np.searchsorted(ends[:, j], b, side="right")) for b in range(n)]


# --- secrets ----------------------------------------------------------------------------------------


def _climb(nodes, x):
    at = 0
    while nodes[at][0] >= 0:
        at = int(nodes[at][2] if x[int(nodes[at][0])] <= nodes[at][1] else nodes[at][3])
    return nodes[at][4]


def test_secrets_one_tree_at_a_time(spark):
    forest = X.fit_forest(X.labelled_findings(800, 3))
    rows = [(i, f"{words(5, i)} {b}{v}{a} {words(3, i)}", "en", p) for i, (v, b, a, p, _) in enumerate(X.labelled_findings(60, 21))] + [(900, None), (901, "")]
    want = []
    for i, text, *more in rows:
        path = more[1] if more else "s0"
        for s, e, rule in X.findings(text):
            x = X.describe(text[s:e], text[max(0, s - X.CONTEXT) : s], text[e : e + X.CONTEXT], path)
            p = sum(_climb(t.tolist(), x) for t in forest.trees) / len(forest.trees)
            if p >= X.ACCEPT:
                want.append((i, s, e, rule, round(p, 9)))
    got = [(r.doc_id, r.start, r.end, r.rule, round(r.score, 9)) for r in X.scan_secrets(make_docs(spark, rows), forest).collect()]
    assert sorted(got) == sorted(want) and len(want) > 20


# --- stages of the pipeline ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, i % 2) for i in range(4, 14)], "doc_id long, quality int").write.parquet(str(d / "labels.parquet"))
    return str(d)


@pytest.mark.parametrize("k", range(5))
def test_stages_on_edge_cases(spark, edge_docs, clashing, labels_dir, k):
    import corpus_pipeline as P

    name, stage = P.STAGES[k]
    out = stage(spark, edge_docs, labels_dir)
    plain = rows_of(out)
    last = name == "packing"
    assert last or out.columns == edge_docs.columns
    more = stage(spark, clashing, labels_dir)
    assert rows_of(more if last else more.select(edge_docs.columns)) == plain and (last or more.columns == clashing.columns)
    assert rows_of(stage(spark, edge_docs.limit(0), labels_dir)) == []
    ids = Counter(r[0] for r in plain)
    long = next(r[1] for r in edge_rows() if r[0] == 4)
    if name == "quality":
        assert not {1, 2, 3} & set(ids) and all(r in {tuple(x) for x in edge_docs.collect()} for r in plain)
    elif name == "repeated_lines":
        text = {r[0]: r[1] for r in plain if r[0] is not None}
        assert text[4] == long and 5 not in text and 11 not in text and text[1] is None and text[2] == "" and ids[None] == 2
    elif name == "near_copies":
        assert {4, 6, 9, 10, 12, 13, 1, 2, 3} == set(ids) - {None} and ids[None] == 2 and ids[9] == 2
    elif name == "mixing":
        assert None not in ids and ids[7] == 2
    else:
        assert {4, 5, 6, 7, 8, 9, 10, 11, 12, 13} == set(ids) and ids[7] == 2 and ids[4] == math.ceil(60_000 / packing.CAPACITY)
