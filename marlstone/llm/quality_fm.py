"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

score = w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]; the pairwise
term costs time linear in the features of a document.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import labelled

WORD_BITS, META_BITS, FACTORS = 16, 8, 6
#: Labelled documents to fit on; a bound on the sample, never on what is scored.
SAMPLE = 6000
#: Below one half, since a good document lost costs more than a bad one kept.
KEEP = 0.35
_CUTS = {
    "symbols": (0.002, 0.01, 0.03, 0.06, 0.1, 0.2),
    "upper": (0.005, 0.02, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "spaces": (0.05, 0.1, 0.14, 0.18, 0.22, 0.3),
    "word": (2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 12.0),
    "distinct": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9),
    "echo": (0.002, 0.01, 0.05, 0.2, 0.5),
    "bang": (0.001, 0.005, 0.02, 0.1),
    "bar": (0.001, 0.01, 0.03, 0.1),
    "line": (10, 40, 100, 250, 600, 2000),
    "length": (20, 80, 250, 800, 2500, 8000, 30000),
}
STRUCT0 = 1 << WORD_BITS
META0 = STRUCT0 + 16 * len(_CUTS)
SIZE = META0 + (1 << META_BITS)
_ASCII = bytes(range(128))
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_SYMBOLS = bytes(c for c in range(256) if chr(c).isalnum() or c <= 32 or c >= 128 or chr(c) in ".,;:'\"!?()-|")
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


class Featurizer:
    def batch(self, texts, langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature, value) of several texts, in no order."""
        texts = [t or "" for t in texts]
        n = len(texts)
        ends, h, _ = C.word_hashes(texts)
        words = np.diff(ends, prepend=0)
        of = np.repeat(np.arange(n), words)
        code, counts = np.unique(of << WORD_BITS | (h & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64), return_counts=True)
        w_row, w_idx, tf = code >> WORD_BITS, code & ((1 << WORD_BITS) - 1), np.log1p(counts)
        norm = np.sqrt(np.bincount(w_row, tf * tf, n))
        by = np.sort(of.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))  # texts first, so that ``of`` fits it
        new = np.ones(len(h), bool)
        new[1:] = by[1:] != by[:-1]
        echo = np.zeros(len(h), bool)
        echo[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        count = lambda f: np.array([f(x) for x in raw], float)
        left = lambda drop: count(lambda x: len(x.translate(None, drop)))
        size = np.maximum(1, np.array([len(t) for t in texts], float))
        spaces, some = count(lambda x: x.count(b" ")), np.maximum(1, words)
        stats = (
            left(_SYMBOLS) / size,
            left(_NOT_UPPER) / np.maximum(1, count(len) - spaces),
            left(_NOT_DIGIT) / size,
            spaces / size,
            size / some,
            np.bincount(of[new], minlength=n) / some,
            np.bincount(of[echo], minlength=n) / np.maximum(1, words - 1),
            count(lambda x: x.count(b"!")) / size,
            count(lambda x: x.count(b"|")) / size,
            size / (1 + count(lambda x: x.count(b"\n"))),
            size,
        )
        struct = np.stack([STRUCT0 + 16 * i + np.searchsorted(cuts, v) for i, (cuts, v) in enumerate(zip(_CUTS.values(), stats))], 1) if n else np.zeros((0, len(_CUTS)), np.int64)
        meta = [{META0 + zlib.crc32(f"{k}={v}".encode("utf-8", "surrogatepass")) % (1 << META_BITS) for k, v in (("lang", lang), ("source", source))} for lang, source in zip(langs, sources)]
        row = np.concatenate([w_row, np.repeat(np.arange(n), len(_CUTS)), np.repeat(np.arange(n), [len(m) for m in meta])]).astype(np.int64)
        idx = np.concatenate([w_idx, struct.reshape(-1), np.array([x for m in meta for x in sorted(m)], np.int64)]).astype(np.int64)
        val = np.concatenate([tf / norm[w_row], np.full(n * len(_CUTS), 0.5), np.full(sum(map(len, meta)), 0.2)]).astype(np.float32)
        return row, idx, val

    def __call__(self, text: str | None, lang: str | None, source: str | None) -> tuple[np.ndarray, np.ndarray]:
        return self.batch([text], [lang], [source])[1:]


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def score(self, idx: np.ndarray, val: np.ndarray) -> float:
        vx = self.v[idx] * val[:, None]
        s = vx.sum(0)
        return float(self.w0 + self.w[idx] @ val + 0.5 * (s @ s - (vx * vx).sum()))

    def probabilities(self, rows: int, x: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """Of a good document, for several texts whose features are (row, feature, value)."""
        row, idx, val = x
        z = self.w0 + np.bincount(row, self.w[idx] * val, rows)
        for v in self.v.T:
            vx = v[idx] * val
            z += 0.5 * (np.bincount(row, vx, rows) ** 2 - np.bincount(row, vx * vx, rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    @staticmethod
    def fit(rows: list, y: list[int], epochs: int = 6, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> "FactorisationMachine":
        """Logistic loss by Adagrad, one document at a time, classes weighted to equal mass."""
        rng = np.random.default_rng(seed)
        w, v = np.zeros(SIZE, np.float32), (rng.standard_normal((SIZE, FACTORS)) * 0.02).astype(np.float32)
        gw, gv, w0, g0 = np.full(SIZE, 1e-6, np.float32), np.full((SIZE, FACTORS), 1e-6, np.float32), 0.0, 1e-6
        share = {c: len(y) / (2 * max(1, y.count(c))) for c in (0, 1)}
        for _ in range(epochs):
            for k in rng.permutation(len(rows)):
                idx, val = rows[k]
                vi = v[idx]
                s = (vi * val[:, None]).sum(0)
                z = w0 + w[idx] @ val + 0.5 * (s @ s - ((vi * val[:, None]) ** 2).sum())
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[k]) * share[y[k]]
                g0 += e * e
                w0 -= rate * e / np.sqrt(g0)
                d = e * val + decay * w[idx]
                gw[idx] += d * d
                w[idx] -= rate * d / np.sqrt(gw[idx])
                d = e * val[:, None] * (s - vi * val[:, None]) + decay * vi
                gv[idx] += d * d
                v[idx] -= rate * d / np.sqrt(gv[idx])
        return FactorisationMachine(float(w0), w, v)

    def dump(self) -> bytes:
        np.savez_compressed(out := io.BytesIO(), w0=self.w0, w=self.w, v=self.v)
        return out.getvalue()

    @staticmethod
    def load(blob: bytes) -> "FactorisationMachine":
        z = np.load(io.BytesIO(blob))
        return FactorisationMachine(float(z["w0"]), z["w"], z["v"])


def _train(rows: list, y: list[int]) -> bytes:
    f = Featurizer()
    return FactorisationMachine.fit([f(r["text"], r["lang"], r["source"]) for r in rows], y).dump()


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> bytes | None:
    """The fitted machine, or None where the labels have no two classes."""
    return labelled.fit(labelled.sample(docs, labels, "quality", sample, ["text", "lang", "source"]), _train)


def _kept(texts: pa.Array, p: np.ndarray | None, keep: float) -> np.ndarray:
    said = np.array([bool(t and not t.isspace()) for t in C.each(texts)], bool)
    return said if p is None else said & (p >= keep)


def score_quality(docs: DataFrame, model: bytes | None, keep: float = KEEP) -> DataFrame:
    """(doc_id, quality, keep) for every row of ``docs``.

    quality is the machine's probability of a good document.  An empty or null text is scored on
    structure and metadata alone and never kept; a very long one is scored whole; a null lang or
    source is a value of its own.  Without a model (no labels of two classes) quality is null and
    every other document is kept.  A null doc_id passes through.  Equal rows get equal results.
    Other columns are ignored; an empty table gives an empty result.
    """
    blob = docs.sparkSession.sparkContext.broadcast(model)

    @C.lean
    def run(batches):
        fm, f = FactorisationMachine.load(blob.value) if blob.value else None, Featurizer()
        for b in (x for y in batches for x in C.slices(y, 1)):
            p = None if fm is None else fm.probabilities(b.num_rows, f.batch(C.each(b.column(1)), b.column(2).to_pylist(), b.column(3).to_pylist()))
            q = pa.nulls(b.num_rows, pa.float64()) if p is None else pa.array(p)
            yield pa.RecordBatch.from_arrays([b.column(0), q, pa.array(_kept(b.column(1), p, keep))], names=["doc_id", "quality", "keep"])

    src = C.require(docs, "doc_id", "text", "lang", "source").select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"), F.col("source").cast("string"))
    return src.mapInArrow(run, "doc_id long, quality double, keep boolean")


def keep_quality(docs: DataFrame, model: bytes | None, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that the machine keeps (see :func:`score_quality`), all columns as they
    are, in one pass: not those of null, empty or blank text; those with a null doc_id are judged
    like others; equal rows stay or go together; an empty table stays so."""
    blob = docs.sparkSession.sparkContext.broadcast(model)
    at = [docs.columns.index(c) for c in ("text", "lang", "source")]

    @C.lean
    def run(batches):
        fm, f = FactorisationMachine.load(blob.value) if blob.value else None, Featurizer()
        for b in (x for y in batches for x in C.slices(y, at[0])):
            texts = b.column(at[0])
            p = None if fm is None else fm.probabilities(b.num_rows, f.batch(C.each(texts), *(b.column(i).to_pylist() for i in at[1:])))
            yield b.filter(pa.array(_kept(texts, p, keep)))

    return docs.mapInArrow(run, docs.schema)
