"""Toxicity severity by cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(theta_k - w.x) with theta_1 < theta_2 < ...: all thresholds share the
weights w.  Features are hashed words and their leading 4 to 7 letters, each with the logarithm of
how many distinct words of the text have it; those that don't differ between the labelled classes
keep weight zero, the others are fitted by maximum penalised likelihood over the whole sample.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled

BITS = 18
#: Labelled documents to fit on; a bound on the sample, never on what is scored.
SAMPLE = 12000
GRADES = 4
EVIDENCE = 3.0


PREFIXES = (4, 5, 6, 7)
_PREFIX = 0xA24BAED4963EE407
_SLOTS = (1 << BITS) - 1


def slots_of(word: str) -> list[int]:
    """The slots of a lower-cased word and of its leading 4 to 7 letters."""
    return [C.word_hash(word) & _SLOTS, *(int(C.mix(np.array([C.word_hash(word[:k]) ^ _PREFIX], np.uint64))[0]) & _SLOTS for k in PREFIXES if len(word) >= k)]


class Featurizer:
    """Features of texts; with ``told``, a mask of slots, of those slots only."""

    def __init__(self, told: np.ndarray | None = None):
        self.told = told

    def batch(self, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, slot, value) of all features of several texts, in that order."""
        ends, h, heads = C.word_hashes(texts, PREFIXES)
        row = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        key = row.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24)
        first = np.unique(key, return_index=True)[1]  # distinct words of each text, by 40 bits of their hash
        codes = []
        for k in (0, *PREFIXES):
            x = h[first] if k == 0 else heads[k][first]
            slot = ((x if k == 0 else C.mix(x ^ np.uint64(_PREFIX))) & np.uint64(_SLOTS)).astype(np.int64)
            ok = (x != 0) if k else np.ones(len(x), bool)
            if self.told is not None:
                ok &= self.told[slot]
            codes.append(row[first[ok]] << BITS | slot[ok])
        code, n = np.unique(np.concatenate(codes), return_counts=True)
        return code >> BITS, code & _SLOTS, np.log2(1.0 + n)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Slots and their values."""
        return self.batch([text])[1:]


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class CumulativeLink:
    def __init__(self, w: np.ndarray, theta: np.ndarray):
        self.w, self.theta = w, theta

    def above(self, x: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """P(grade > k) for k = 0, 1, ..."""
        return _sigmoid(self.w[x[0]] @ x[1] - self.theta)

    def above_each(self, rows: int, x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The same for several texts, whose features are (row, slot, value)."""
        return _sigmoid(np.bincount(x[0], self.w[x[1]] * x[2], rows)[:, None] - self.theta)

    @staticmethod
    def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: list[int], steps: int = 500, rate: float = 0.1, ridge: float = 2.0, z_least: float = 2.5, balance: float = 0.5) -> "CumulativeLink":
        y_ = np.asarray(y)
        k = int(y_.max())
        col, val = np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows])
        row = np.repeat(np.arange(len(rows)), [len(i) for i, _ in rows])
        pos = y_ > 0
        moment = lambda mask, p: np.bincount(col[mask[row]], val[mask[row]] ** p, 1 << BITS) / max(1, mask.sum())
        a, b = moment(pos, 1), moment(~pos, 1)
        # variances with half an observation more, so that a feature seen once or twice tells nothing
        spread = sum((moment(m, 2) - x * x + 0.5 / (m.sum() + 1)) / (m.sum() + 1) for m, x in ((pos, a), (~pos, b)))
        told = np.abs(a - b) >= z_least * np.sqrt(spread)
        slot = np.cumsum(told) - 1
        used = told[col]
        col, row, val = slot[col[used]], row[used], val[used]
        m = int(told.sum())
        w, theta = np.zeros(m), np.linspace(1.0, k, k)
        state = np.zeros((2, m + k))
        n = len(rows)
        l2 = ridge / n
        # 0: documents weigh the same, 1: classes do
        mass_of = np.where(pos, (n / (2 * max(1, pos.sum()))) ** balance, (n / (2 * max(1, (~pos).sum()))) ** balance)
        for step in range(1, steps + 1):
            s = np.bincount(row, w[col] * val, n)
            p = _sigmoid(s[:, None] - np.concatenate([[-60.0], theta, [60.0]]))  # P(grade > j), j = -1 .. k
            lo, hi = p[np.arange(n), y_], p[np.arange(n), y_ + 1]
            mass = np.maximum(lo - hi, 1e-9)
            dlo, dhi = mass_of * lo * (1 - lo) / mass, mass_of * hi * (1 - hi) / mass
            gw = np.bincount(col, (dhi - dlo)[row] * val, m) / n + l2 * w
            gt = np.array([dlo[y_ == j + 1].sum() - dhi[y_ == j].sum() for j in range(k)]) / n
            g = np.concatenate([gw, gt])
            state[0] = 0.9 * state[0] + 0.1 * g
            state[1] = 0.99 * state[1] + 0.01 * g * g
            d = rate * (state[0] / (1 - 0.9**step)) / (np.sqrt(state[1] / (1 - 0.99**step)) + 1e-6)
            w -= d[:m]
            theta = np.maximum.accumulate(theta - d[m:]) + np.arange(k) * 1e-6
        full = np.zeros(1 << BITS)
        full[told] = w
        return CumulativeLink(full, theta)

    def dump(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), w=self.w.astype(np.float32), theta=self.theta)
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> "CumulativeLink":
        z = np.load(io.BytesIO(blob))
        return CumulativeLink(z["w"].astype(np.float64), z["theta"])


def grade(rows: list[tuple[np.ndarray, np.ndarray]], toxic: list[int], grades: int = GRADES) -> list[int]:
    """Ordered grades where the labels only say toxic or not: 0, and toxic documents by how many
    features they hold that the labels show to be toxic (log odds over EVIDENCE), cut at quantiles.
    Labels that already have more than two values are returned as they are."""
    if max(toxic) > 1:
        return list(toxic)
    count = np.zeros((2, 1 << BITS))
    for (x, _), t in zip(rows, toxic):
        count[t, x] += 1
    n = [max(1, toxic.count(c)) for c in (0, 1)]
    told = (np.log((count[1] + 0.5) / n[1]) - np.log((count[0] + 0.5) / n[0]) > EVIDENCE) & (count[1] >= 0.01 * n[1])
    share = np.array([told[x].sum() for x, _ in rows])
    cuts = np.quantile(share[np.array(toxic) == 1], np.arange(1, grades - 1) / (grades - 1))
    return [1 + int(np.searchsorted(cuts, s, side="left")) if t else 0 for s, t in zip(share, toxic)]


def _train(rows: list, y: list[int]) -> bytes:
    f = Featurizer()
    x = [f(r["text"]) for r in rows]
    return CumulativeLink.fit(x, grade(x, y)).dump()


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """The model of labels ``toxic``, graded (0, 1, 2, ...) or, as in the tables here, 0 and 1 only, for
    which :func:`grade` makes up grades to show the method; None if the labels have no two values."""
    return labelled.fit(labelled.sample(docs, labels, "toxic", sample, ["text"]), _train)


def score_toxicity(docs: DataFrame, model: bytes | None) -> DataFrame:
    """(doc_id, expected_severity, grade, toxic) for every row of ``docs``.

    expected_severity is the mean grade, the sum over k of P(grade > k); grade is the number of
    thresholds that are more likely passed than not; toxic means grade >= 1.  A null, empty or
    wordless text has no features: severity 0, grade 0; a very long one is scored whole.  Without a
    model (no labels of two classes) severity and grade are null and toxic is false.  A null doc_id
    passes through; equal rows get equal results; other columns are ignored; an empty table gives
    an empty result.
    """
    names = ["doc_id", "expected_severity", "grade", "toxic"]
    blob = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = CumulativeLink.load(blob.value) if blob.value else None
        f = Featurizer(m.w != 0) if m else None
        for b in (x for y in batches for x in C.slices(y, 1)):
            texts, n = b.column(1), b.num_rows
            if m is None:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))], names=names)
                continue
            p = m.above_each(n, f.batch(C.each(texts)))
            p[np.array([not C.WORD.search(t or "") for t in C.each(texts)], bool)] = 0.0
            grade = (p >= 0.5).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(1)), pa.array(grade.astype(np.int32)), pa.array(grade > 0)], names=names)

    return C.require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, expected_severity double, grade int, toxic boolean")
