"""Arrow batches in Python workers: in portions, with memory given back; tokens of texts by batch."""

from __future__ import annotations

import ctypes
import hashlib
import inspect
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """What this process has freed goes back to the system.

    Workers live on between tasks, and without this each keeps the most that it ever held.
    """
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def lean(f):
    """``f``, a function or generator of a worker, with :func:`give_back` after its end."""
    if inspect.isgeneratorfunction(f):

        @wraps(f)
        def run(*args):
            try:
                yield from f(*args)
            finally:
                give_back()
    else:

        @wraps(f)
        def run(*args):
            try:
                return f(*args)
            finally:
                give_back()

    run.__signature__ = inspect.signature(f)  # Spark asks how many arguments there are
    return run


def portions(batch: pa.RecordBatch, sizes, limit: int):
    """The batch in parts whose ``sizes``, one for each row, come to about ``limit``; a row at least."""
    total = np.cumsum(np.asarray(sizes, np.int64))
    lo = 0
    while lo < batch.num_rows:
        done = int(total[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(column) -> np.ndarray:
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def lengths(lists) -> np.ndarray:
    """Members of each list of a column without nulls."""
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def kind(df: DataFrame, column: str) -> pa.DataType:
    """What Arrow calls the type of a column."""
    return to_arrow_type(df.schema[column].dataType)


#: Tokens of a portion.
STEP = 1 << 19


def by_tokens(batches, at: int, row: int = 1):
    """The batches in portions of about :data:`STEP` tokens in the lists of column ``at``; a row
    counts as ``row`` more."""
    for b in batches:
        yield from portions(b, lengths(b.column(at)) + row, STEP)


def coded(lists) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, code, words): the row of each token and its number among the distinct ``words``."""
    found = lists.flatten().dictionary_encode()
    return np.repeat(np.arange(len(lists)), lengths(lists)), found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def counts(row: np.ndarray, code: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, n) of the distinct pairs, in their order; codes are below ``width``."""
    key, n = np.unique(row * max(1, width) + code, return_counts=True)
    return key // max(1, width), key % max(1, width), n


class Hashed:
    """Cell and sign of tokens in a signed feature hash of ``dim`` cells; some tokens are kept."""

    KEPT = 200_000

    def __init__(self, dim: int):
        self.dim, self.known = dim, {}

    def _of(self, word: str) -> int:
        d = hashlib.sha256(word.encode("utf-8", "surrogatepass")).digest()
        at = int.from_bytes(d[:4], "big") % self.dim * 2 + (d[4] & 1)
        if len(self.known) >= self.KEPT:
            self.known.clear()
        self.known[word] = at
        return at

    def matrix(self, lists) -> np.ndarray:
        """The unit vectors of lists of tokens; a list whose tokens cancel out, or without any, has the
        first unit vector."""
        row, code, words = coded(lists)
        known = self.known.get
        at = np.fromiter((v if (v := known(w)) is not None else self._of(w) for w in words.to_pylist()), np.int64, len(words))
        x = np.bincount(row * self.dim + (at >> 1)[code], weights=((at & 1) * 2.0 - 1)[code], minlength=len(lists) * self.dim).reshape(len(lists), self.dim)
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        x = np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)
        x[norm[:, 0] == 0, 0] = 1.0
        return x


class Best:
    """The k best of each of ``n`` queries among what was offered: score descending, id ascending."""

    def __init__(self, n: int, k: int):
        self.k, self.held, self.least = k, [None] * n, np.full(n, -np.inf)

    def offer(self, query: int, ids: np.ndarray, scores: np.ndarray, at: np.ndarray) -> None:
        """Scores, and ids, of the positions ``at``."""
        at = at[scores[at] >= self.least[query]]
        if len(at) > self.k:
            s = scores[at]
            at = at[s >= np.partition(s, -self.k)[-self.k]]
        if not len(at):
            return
        i, s = ids[at], scores[at]
        if (held := self.held[query]) is not None:
            i, s = np.concatenate([held[0], i]), np.concatenate([held[1], s])
        order = np.lexsort((i, -s))[: self.k]
        self.held[query] = i[order], s[order]
        if len(order) == self.k:
            self.least[query] = s[order[-1]]

    def batches(self, queries: pa.Array, id_kind: pa.DataType, rows: int = 1 << 16):
        """(query_id, chunk_id, relevance) of what is held."""
        at, n = [], 0
        for q, held in enumerate(self.held):
            if held is not None:
                at.append(q)
                n += len(held[0])
            if at and (n >= rows or q == len(self.held) - 1):
                yield self._batch(at, queries, id_kind)
                at, n = [], 0
        if at:
            yield self._batch(at, queries, id_kind)

    def _batch(self, at, queries, id_kind) -> pa.RecordBatch:
        which = np.repeat(at, [len(self.held[q][0]) for q in at])
        ids, scores = (np.concatenate([self.held[q][j] for q in at]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([queries.take(pa.array(which)), pa.array(ids, id_kind), pa.array(scores, pa.float64())], names=["query_id", "chunk_id", "relevance"])
