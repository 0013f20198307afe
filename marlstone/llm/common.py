"""Shared helpers: written tables in the cluster's shared folder, tokenisation, hashing."""

from __future__ import annotations

import atexit
import re
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import give_back, lean, portions, text_bytes  # noqa: F401
from ..session import work_dir

WORD = re.compile(r"[^\W_]+")
MASK = (1 << 64) - 1
#: Largest side, in bytes, that is ever broadcast; beyond it the same join runs as a shuffle.
BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, spark: SparkSession | None = None, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in one folder for each value of ``by``, and read
    it back: lineage ends at files that outlive any executor."""
    spark = spark or df.sparkSession
    path = fresh_path(spark, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> list[tuple[SparkSession, str]]:
    """The tables written so far and not released."""
    return list(_written)


def release(tables: list | None = None) -> None:
    """Delete written tables (all of them by default) that no later result reads."""
    for item in written() if tables is None else tables:
        if item not in _written:
            continue
        _written.remove(item)
        spark, path = item
        try:
            jvm = spark.sparkContext._jvm
            hadoop = jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may be gone at exit
            pass


atexit.register(release)


#: What a row costs in a broadcast hash table beside its values.
ROW_OVERHEAD = 112


def small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """Broadcast hint only if the counted rows fit :data:`BROADCAST_BYTES`; otherwise unchanged."""
    return F.broadcast(df) if rows * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES else df


def squeeze(values: np.ndarray) -> bytes:
    """Differences of neighbours, compressed: for columns that are sorted or come in runs."""
    d = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(d.tobytes())


def unsqueeze(blob: bytes, dtype) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype), dtype=dtype)


#: Bytes of text that are taken apart at once, to bound a worker's memory.
SLICE = 2 << 20


def slices(batch: pa.RecordBatch, at: int, limit: int | None = None):
    """The batch in parts of about ``limit`` bytes of its text column ``at``, a row at least."""
    return portions(batch, text_bytes(batch.column(at)), limit or SLICE)


def each(column):
    """Values of an Arrow column one by one, never all as Python objects at once."""
    return (x.as_py() for x in column)


def words(text: str | None) -> list[str]:
    """Lower-cased runs of letters and digits; none for a null text."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values (Stafford's variant 13)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Code points that are hashed together; longer texts are cut between words.
PIECE = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_BETWEEN = re.compile(r"[\W_]")


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, and which code points make words."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)
        self.word = np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            n = 1 << n.bit_length()
            made = []
            for base in (_BASE, pow(_BASE, -1, 1 << 64)):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                with np.errstate(over="ignore"):
                    made.append(np.cumprod(x))
            self.up, self.down = made
        return self.up, self.down


_powers: list[_Powers] = []


def _pieces(texts, limit: int):
    """Groups of (text, piece) of about ``limit`` code points; a long text is cut between words."""
    held, size = [], 0
    for i, text in enumerate(texts):
        text, at = (text or "").lower(), 0
        while len(text) - at > limit:
            m = _BETWEEN.search(text, at + limit)
            if not m:
                break
            held.append((i, text[at : m.start()]))
            yield held
            held, size, at = [], 0, m.end()
        held.append((i, text[at:]))
        size += len(text) - at
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def word_hashes(texts, prefixes: tuple[int, ...] = (), limit: int | None = None) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """(ends, hashes, starts of words) of an iterable of texts: text i has the words, lower-cased runs of
    letters and digits, of ``hashes[ends[i - 1] : ends[i]]``; for each k of ``prefixes`` the hashes of
    the words' first k letters, 0 for shorter words.

    A word's hash is a polynomial in its code points modulo 2^64, from differences of running sums
    over the whole piece, so that no word is looked at by itself.
    """
    if not _powers:
        _powers.append(_Powers())
    counts: list[np.ndarray] = []
    owner, found, heads = [], [], {k: [] for k in prefixes}
    for piece in _pieces(texts, limit or PIECE):
        code = np.frombuffer("\n".join(t for _, t in piece).encode("utf-32-le", "surrogatepass"), np.uint32)
        up, down = _powers[0].to(len(code) + 1)
        inside = np.zeros(len(code) + 2, np.int8)
        inside[1:-1] = _powers[0].word[code]
        edge = np.flatnonzero(np.diff(inside))
        lo, hi = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            total = np.zeros(len(code) + 1, np.uint64)
            np.cumsum((code.astype(np.uint64) + np.uint64(1)) * down[: len(code)], out=total[1:])
            of = lambda a, b: mix((total[b] - total[a]) * up[b - 1] if len(a) else np.zeros(0, np.uint64))
            found.append(of(lo, hi))
            for k in prefixes:
                heads[k].append(np.where(hi - lo >= k, of(lo, np.minimum(lo + k, hi)), np.uint64(0)))
        begins = np.cumsum([0, *(len(t) + 1 for _, t in piece[:-1])])
        owner.append(np.array([i for i, _ in piece], np.int64)[np.searchsorted(begins, lo, side="right") - 1])
        counts.append(np.array([piece[-1][0] + 1]))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    n = int(counts[-1][0]) if counts else 0
    return np.cumsum(np.bincount(join(owner, np.int64), minlength=n)), join(found, np.uint64), {k: join(v, np.uint64) for k, v in heads.items()}


def word_hash(word: str) -> int:
    """The hash of one lower-cased word, by the polynomial itself."""
    h = 0
    for c in word:
        h = (h * _BASE + ord(c) + 1) & MASK
    return int(mix(np.array([h], np.uint64))[0])


def ngram_sets(texts, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text; 1 to n-1 words are one gram."""
    ends, h, _ = word_hashes(texts)
    out = []
    with np.errstate(over="ignore"):
        g = h[: max(0, len(h) - n + 1)].copy()
        for k in range(1, n):
            g = g * np.uint64(_BASE) + h[k : len(h) - n + 1 + k]
        g = mix(g + np.uint64(n))
        at = 0
        for end in ends.tolist():
            if end - at >= n:
                out.append(np.unique(g[at : end - n + 1]))
            elif end == at:
                out.append(h[:0])
            else:
                one = h[at]
                for k in range(at + 1, end):
                    one = one * np.uint64(_BASE) + h[k]
                out.append(mix(np.array([one], np.uint64) + np.uint64(end - at)))
            at = end
    return out


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def require(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns, whatever their names, can't clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])
