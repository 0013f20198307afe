"""Packing documents into training windows by Karmarkar-Karp multiway differencing.

Pieces start as partial partitions with one filled window each.  The two partitions of the
largest imbalance merge, the fullest windows of one with the emptiest of the other, until one
partition is left: windows of near-equal load.  If its fullest window exceeds the capacity, the
number of windows rises and the differencing is done again.

Differencing runs in blocks of about BLOCK_WINDOWS windows of tokens, to which a hash assigns the
pieces, so that the loss of a block's last window is the same share at every size of corpus and
document.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

CAPACITY = 4096
#: Windows' worth of tokens that are differenced together; the number of such blocks follows the
#: tokens of the corpus.
BLOCK_WINDOWS = 64
#: Copies of one piece that are numbered at a time.
COPIES = 4096


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Largest differencing method for ``windows`` parts: the members of each part."""
    if not len(sizes):
        return [[] for _ in range(windows)]
    tie = 0
    heap = []
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        load = np.zeros(windows, np.int64)
        load[0] = sizes[i]
        # loads descending; members alongside, None for an empty window
        heap.append((-int(sizes[i]) if windows > 1 else 0, tie, load, [[i]] + [None] * (windows - 1)))
        tie += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, la, ma = heapq.heappop(heap)
        _, _, lb, mb = heapq.heappop(heap)
        load = la + lb[::-1]
        members = [x + y if x and y else x or y for x, y in zip(ma, reversed(mb))]
        by = np.argsort(-load, kind="stable")
        load = load[by]
        load -= load[-1]  # only differences matter
        heapq.heappush(heap, (-int(load[0]), tie, load, [members[j] for j in by.tolist()]))
        tie += 1
    return [m or [] for m in heap[0][3]]


def pack(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Non-empty windows of at most ``capacity``; every size must fit on its own."""
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes):
        return []
    windows = max(1, math.ceil(int(sizes.sum()) / capacity))
    while True:
        parts = differencing(sizes, windows)
        if max(int(sizes[p].sum()) for p in parts) <= capacity:
            return [p for p in parts if p]
        windows += 1


def _windows(capacity: int):
    @C.lean
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "start_token", "n_tokens", "copy"], kind="stable").reset_index(drop=True)
        size = pdf["n_tokens"].to_numpy(np.int64)
        window, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        base = int(pdf["block"].iloc[0]) << 32
        for w, part in enumerate(pack(size, capacity)):
            part = sorted(part)
            window[part] = base + w
            offset[part] = np.cumsum(size[part]) - size[part]
        return pdf[["doc_id", "start_token", "n_tokens"]].assign(window_id=window, window_offset=offset.astype(np.int32))

    return run


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: Lead bytes of the white space beyond ASCII.
_FURTHER = np.zeros(256, bool)
_FURTHER[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def token_counts(texts: pa.Array) -> np.ndarray:
    """Tokens of each text, as ``str.split`` has them: runs without white space of any script."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    at = ends - ends[0]
    space = _SPACE[raw]
    start = ~space
    start[1:] &= space[:-1]
    first = at[:-1][at[1:] > at[:-1]]
    start[first] = ~space[first]
    # places, not running sums: their memory is that of the tokens, not eight times the text
    out = np.diff(np.searchsorted(np.flatnonzero(start), at))
    odd = np.diff(np.searchsorted(np.flatnonzero(_FURTHER[raw]), at))
    for i in np.flatnonzero(odd).tolist():
        out[i] = len(texts[i].as_py().split())
    return out


@C.lean
def _count(batches):
    for b in (x for y in batches for x in C.slices(y, 1)):
        n = token_counts(b.column(1))
        rows = pa.array(np.flatnonzero(n))
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(n[n > 0])], names=["doc_id", "tokens"])


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """(doc_id, start_token, n_tokens, window_id, window_offset): where each piece of each
    document lies.

    Tokens are runs without white space.  A document of more than ``capacity`` tokens, however
    long, is cut into pieces of ``capacity`` and a rest; every token is in exactly one piece and no
    window holds more than ``capacity``.  Pieces are spread over blocks by a hash and packed per
    block; ties in size go by doc_id and start.  A null, empty or blank text has no tokens and no
    piece; rows with a null doc_id are left out; rows that repeat a doc_id are packed one by one.
    Other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    src = C.require(docs, "doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count, "doc_id long, tokens long")
    pieces = src.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(capacity).cast("long"))).alias("start_token"))
    pieces = pieces.select("doc_id", F.col("start_token").cast("int").alias("start_token"), F.least(F.col("tokens") - F.col("start_token"), F.lit(capacity)).cast("int").alias("n_tokens"))
    pieces = C.table(pieces.groupBy("doc_id", "start_token", "n_tokens").count(), "pack-pieces")  # equal pieces are numbered, to part them
    total = pieces.agg(F.sum(F.col("n_tokens") * F.col("count"))).first()[0]
    if not total:
        return spark.createDataFrame([], "doc_id long, start_token int, n_tokens int, window_id long, window_offset int")
    blocks = math.ceil(total / (capacity * block_windows))
    some = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1, F.lit(COPIES).cast("long"))).alias("from"))
    each = some.select("doc_id", "start_token", "n_tokens", F.explode(F.sequence("from", F.least(F.col("from") + COPIES, F.col("count")) - 1)).alias("copy"))
    placed = each.withColumn("block", F.pmod(F.xxhash64("doc_id", "start_token", "copy"), F.lit(blocks)))
    return placed.groupBy("block").applyInPandas(_windows(capacity), "doc_id long, start_token int, n_tokens int, window_id long, window_offset int")
