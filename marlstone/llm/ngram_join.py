"""Size-aware heavy-light Jaccard self-join over word n-gram sets.

Two sets with Jaccard >= t share at least ``o = ceil(t * size)`` grams, ``size`` being that of
either.  Under any total order of the grams, the first ``size - o + c`` grams of both then share
at least ``c``.  Small sets enumerate the fixed-size (2-)subsets of that prefix and meet on a
whole subset; large sets scan inverted lists of single prefix grams (``c = 1``).  The size from
which scanning is cheaper is chosen from the size histogram of all sets and the measured list
lengths.  The order puts grams that occur in many documents last: it comes from a count of every
gram of every document in a sketch of fixed size, so it is deterministic and only ever changes
the cost, never the result.

Records travel as packed blocks per (task, shard), not as rows.  Candidates first compare parity
bitmaps of a few bits per gram, whose difference is never more than that of the sets, so that
only pairs that are almost surely similar fetch the sets themselves and are verified exactly.
A gram that more than HOT_LIST documents may hold has its list cut into blocks of documents, and
every pair of blocks is a group of its own.  Verified pairs are never returned: each block of
them comes back as one row per set, with its number of links and its root among the block's.

Pairs within a large group of copies would come again from every shard, as often as the square of
the group.  Sets that agree with many others on a band of least hashes are therefore put into a
group with the smallest of them that their bitmaps allow; all pairs within a group are counted in
one place, and shards leave them out.  Which sets are in a group changes the cost, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

NGRAM, THRESHOLD = 3, 0.5
SKETCH_BITS, CHUNK_BITS = 21, 16
#: Records of one shard, to bound a task's memory.
SHARD_RECORDS = 750_000
#: Entries that a task packs at once, whatever its batches hold.
ENTRY_STEP = 500_000
#: Bytes of sets that meet in one group.
VERIFY_BYTES = 24 << 20
#: Documents of one list that are held against each other in one group.
HOT_LIST = 4096
SUBSET = 2
#: Keys of a set, each of two least hashes, and sets on one key from which they make a group.
BANDS, DENSE = 6, 32
#: Bytes of the sets of a group that are held against each other at once, on either side.
DENSE_BYTES = 6 << 20


def needed(size, t: float):
    return np.ceil(np.asarray(size) * t - 1e-9).astype(np.int64)


def parity(g: np.ndarray) -> bytes:
    """Bitmap of 2 to 4 bits per gram: whether an odd number of grams falls on a bit.  A bitmap is
    folded to half its width by XOR of its halves."""
    width = max(64, 1 << (2 * len(g) - 1).bit_length())
    return np.packbits(np.bincount((g & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


_ODD = C.mix(np.arange(1, 2 * BANDS + 1, dtype=np.uint64)) | np.uint64(1)


def bands(every: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BANDS keys of each of the sets that begin at ``at``; two sets have one in common with the
    probability of their Jaccard squared."""
    with np.errstate(over="ignore"):
        least = [np.minimum.reduceat(every * odd, at) for odd in _ODD]
        keys = [C.mix(a ^ C.mix(b)) >> np.uint64(32) for a, b in zip(least[::2], least[1::2])]
    return np.stack(keys, 1).astype(np.uint32).view(np.int32)


def _profile(n: int):
    names = ["doc_id", "text_key", "size", "hi", "lo", "bits", "bands", "chunk", "blob"]

    @C.lean
    def run(batches):
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in (x for y in batches for x in C.slices(y, 1)):
            sets = C.ngram_sets(C.each(b.column(1)), n)
            size = np.array([len(g) for g in sets], np.int32)
            every, some = np.concatenate(sets), np.flatnonzero(size)
            np.add.at(sketch, (every >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            hi, lo = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            if len(some):
                at = (np.cumsum(size) - size)[some]
                with np.errstate(over="ignore"):
                    hi[some] = np.bitwise_xor.reduceat(C.mix(every), at) ^ size[some].astype(np.uint64)
                    lo[some] = np.add.reduceat(C.mix(every ^ np.uint64(0x5851F42D4C957F2D)), at)
            bits, k = [parity(g) if len(g) else b"" for g in sets], len(sets)
            own = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(size > 0)]) * BANDS, pa.int32()), pa.array(bands(every, at).reshape(-1) if len(some) else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(size), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(bits, pa.binary()), own, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if sketch.any():
            parts = np.minimum(sketch, 255).astype(np.uint8).reshape(-1, 1 << CHUNK_BITS)
            k = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int32())), pa.array(range(k), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return run


def _add_chunks(pdf: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(1 << CHUNK_BITS, np.uint32)
    for b in pdf["blob"]:
        total += np.frombuffer(b, np.uint8)
    return pd.DataFrame({"chunk": [int(pdf["chunk"].iloc[0])], "blob": [total.tobytes()]})


#: How an entry of a list meets others: any of them, or only those of the other side.
ANY, LEFT, RIGHT = 0, 1, 2


def _cut(keys: np.ndarray, doc: np.ndarray, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose lists are cut into ``blocks``, by pairs of blocks: (entry, key, side).

    The document is in block x of its list: in the pair (x, x) it meets any, in (x, y) those of y.
    """
    at = np.repeat(np.arange(len(keys)), blocks)
    n = blocks.astype(np.int64)[at]
    x = (C.mix(doc.view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)[at]
    y = np.arange(len(at)) - np.repeat(np.cumsum(blocks, dtype=np.int64) - blocks, blocks)
    pair = (np.minimum(x, y) * n + np.maximum(x, y) + 1).astype(np.uint64)
    return at, C.mix(keys[at] ^ C.mix(pair)), np.where(y == x, ANY, np.where(x < y, LEFT, RIGHT)).astype(np.int32)


def _entries(sets: list[np.ndarray], ids: np.ndarray, t: float, bound: int, rank: np.ndarray, lists: np.ndarray):
    """(kind, keys, docs, sizes and sides, lasts) of some sets.  kind 0: subsets, 1: lists."""
    size = np.array([len(g) for g in sets], np.int64)
    need, start = needed(size, t), np.cumsum(size) - size
    of = np.repeat(np.arange(len(sets)), size)
    g = np.concatenate(sets)
    cell = (g >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)
    # the global order: frequency class, then hash, by which each set is in order already
    by = np.argsort(of << 8 | rank[cell], kind="stable")
    g, cell = g[by], cell[by]
    small = (size <= bound) & (need >= SUBSET)
    for k in np.flatnonzero(small).tolist():
        p = g[start[k] : start[k] + size[k] - need[k] + SUBSET]
        i, j = np.triu_indices(len(p), 1)
        with np.errstate(over="ignore"):
            keys = C.mix(p[i] * np.uint64(3) ^ C.mix(p[j] ^ p[i]))
        yield 0, keys, np.full(len(i), ids[k]), np.full(len(i), size[k] << 2 | ANY, np.int32), np.zeros(len(i), np.uint32)
    # a subset set is in the lists only if a scanning set can match it
    listed = ~small | (size >= t * (bound + 1) - 1e-9) | (size * t < SUBSET / t + 1)
    head = np.flatnonzero(listed[of] & (np.arange(len(g)) - start[of] <= (size - need)[of]))
    last = start + size - need  # the place, in the global order, where each prefix ends
    place = (rank[cell[last]].astype(np.uint64) << np.uint64(26) | g[last] >> np.uint64(38)).astype(np.uint32)
    blocks = lists[cell[head]]
    for part in (head[blocks == 1], head[blocks > 1]):
        keys, d, side = g[part], of[part], np.zeros(len(part), np.int32)
        if len(part) and lists[cell[part[0]]] > 1:
            at, keys, side = _cut(keys, ids[d], lists[cell[part]])
            d = d[at]
        yield 1, keys, ids[d], (size[d] << 2).astype(np.int32) | side, place[d]


def _signatures(n: int, t: float, bound: int, shards: int, order_b):
    """Blocks of entries (key, doc, size and side, last) per kind and shard, of about ENTRY_STEP.

    A third column, of the groups of the sets, comes back as each entry's doc less its group.
    """

    def packed(kind, found):
        key, doc, size, last, *own = (np.concatenate(c) for c in zip(*found))
        shard = ((key >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(shards + 1))
        rows = [(k, by[cuts[k] : cuts[k + 1]]) for k in range(shards) if cuts[k + 1] > cuts[k]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([kind * shards + k for k, _ in rows], pa.int32()),
                pa.array([(key[x] & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for _, x in rows], pa.binary()),
                pa.array([C.squeeze(doc[x]) for _, x in rows], pa.binary()),
                pa.array([C.squeeze(size[x]) for _, x in rows], pa.binary()),
                pa.array([C.squeeze(last[x]) for _, x in rows], pa.binary()),
                *[pa.array([C.squeeze(doc[x] - o[x]) for _, x in rows], pa.binary()) for o in own],
            ],
            names=["shard", "keys", "docs", "sizes", "lasts", "owns"][: 5 + len(own)],
        )

    @C.lean
    def run(batches):
        rank, lists = order_b.value
        out, held = {0: [], 1: []}, {0: 0, 1: 0}
        for x in (x for b in batches for x in C.slices(b, 1)):
            sets = C.ngram_sets(C.each(x.column(1)), n)
            some = [i for i, g in enumerate(sets) if len(g)]
            if some:
                ids, *own = (c.to_numpy()[some] for c in [x.column(0), *x.columns[2:]])
                by = np.argsort(ids, kind="stable")
                for kind, *entries in _entries([sets[i] for i in some], ids, t, bound, rank, lists):
                    out[kind].append(entries + [o[by][np.searchsorted(ids[by], entries[1])] for o in own])
                    held[kind] += len(entries[0])
                    if held[kind] > ENTRY_STEP:
                        yield packed(kind, out[kind])
                        out[kind], held[kind] = [], 0
        for kind, found in out.items():
            if found:
                yield packed(kind, found)

    return run


#: Pairs that a task holds as numbers at once.
PAIR_STEP = 500_000
_PACKED = "blk int, a binary, b binary, need binary, k binary, n int"


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, n = np.concatenate(codes), np.concatenate(counts)
    by = np.argsort(u, kind="stable")
    u, n = u[by], n[by]
    del by
    at = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
    return u[at], np.add.reduceat(n, at, dtype=np.int32) if len(u) else n


def _pairs(t: float, bound: int, shards: int):
    """All pairs of one shard that meet on a key, but those of one group, with how many keys they meet on.

    Packed by a block of the smaller doc_id and sorted, so that the pairs of large groups, which
    repeat the same partners, compress well when they are moved.  A shard with more pairs than
    PAIR_STEP gives them in portions, in which a pair may come again: its meetings add up.
    """

    blks = max(4, shards // 2)

    def packed(kind, ids, ent, blk, c, n):
        of, size, last, least = ent
        x, y = (c // len(of)).astype(np.int32), (c % len(of)).astype(np.int32)  # ent is sorted by doc_id first
        need = np.zeros(len(c), np.int32)
        for lo in range(0, len(c) if kind else 0, PAIR_STEP // 8 + 1):
            p, q = x[lo : lo + PAIR_STEP // 8 + 1], y[lo : lo + PAIR_STEP // 8 + 1]
            # k common grams within the prefixes: at most rest more, rest following the prefix that
            # ends first in the global order (of the longer one where that can't be told)
            rest = np.where(last[p] < last[q], least[p], np.where(last[p] > last[q], least[q], np.maximum(least[p], least[q]))) - 1
            need[lo : lo + len(p)] = np.maximum(needed(size[p].astype(np.int64) + size[q], t / (1 + t)) - rest, 1)
        by = np.argsort(blk[x], kind="stable")
        cuts = np.searchsorted(blk[x[by]], np.arange(blks + 1))
        rows = [(j, by[cuts[j] : cuts[j + 1]]) for j in range(blks) if cuts[j + 1] > cuts[j]]  # sorted by pair
        return pd.DataFrame([(j, C.squeeze(ids[of[x[i]]]), C.squeeze(ids[of[y[i]]]), C.squeeze(need[i]), C.squeeze(n[i]), len(i)) for j, i in rows], columns=["blk", "a", "b", "need", "k", "n"])

    @C.lean
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kind, blobs = 0, {}
        for pdf in batches:
            kind = int(pdf["shard"].iloc[0]) // shards
            for c in pdf.columns:
                blobs.setdefault(c, []).extend(pdf[c] if c != "shard" else [])
            del pdf
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in blobs.pop("keys")])
        by = np.argsort(key, kind="stable").astype(np.int32)
        key = key[by]
        alone = np.ones(len(key), bool)  # entries that share no key are dropped at once
        alone[1:] &= key[1:] != key[:-1]
        alone[:-1] &= key[1:] != key[:-1]
        by, key = by[~alone], key[~alone]
        del alone

        def column(name, dtype):  # one at a time, of what is left
            return np.concatenate([C.unsqueeze(x, dtype) for x in blobs.pop(name)])[by]

        if not len(key):
            return
        doc = column("docs", np.int64)
        own = doc - column("owns", np.int64) if "owns" in blobs else doc
        grouped = bool((own != doc).any())
        ids, doc = np.unique(doc, return_inverse=True)
        doc = doc.astype(np.int32)
        own = np.unique(own, return_inverse=True)[1].astype(np.int32) if grouped else doc
        size, last = column("sizes", np.int32), column("lasts", np.uint32)
        del by
        # by size, except where sets of one group share a key: by group, so that they are passed over
        shared = np.zeros(len(key), bool)
        if grouped:
            at = np.lexsort((own, key)).astype(np.int32)
            key, doc, size, last, own = key[at], doc[at], size[at], last[at], own[at]
            new = key[1:] != key[:-1]
            of = np.cumsum(np.concatenate([[False], new]), dtype=np.int32)
            twice = np.zeros(of[-1] + 1, bool)
            twice[of[1:][~new & (own[1:] == own[:-1])]] = True
            shared = twice[of]
            del new, of, twice
        at = np.lexsort((doc, np.where(shared, own, size), key)).astype(np.int32)
        key, doc, size, last, own, shared = key[at], doc[at], size[at], last[at], own[at], shared[at]
        side, size = (size & 3).astype(np.int8), size >> 2
        ends = np.flatnonzero(np.append((key[1:] != key[:-1]) | (own[1:] != own[:-1]), True)) + 1
        first = np.where(shared, np.repeat(ends, np.diff(ends, prepend=0)), np.arange(1, len(key) + 1)).astype(np.int32)
        del ends
        by = np.lexsort((last, size, doc)).astype(np.int32)
        new = np.append(True, (doc[by[1:]] != doc[by[:-1]]) | (size[by[1:]] != size[by[:-1]]) | (last[by[1:]] != last[by[:-1]]))
        at = np.zeros(len(key), np.int32)
        at[by] = np.cumsum(new, dtype=np.int32) - 1
        by = by[new]
        ent = doc[by], size[by], last[by], needed(size[by], t).astype(np.int32)
        blk = (C.mix(ids[ent[0]].view(np.uint64)) % np.uint64(blks)).astype(np.int32)
        del by, new, last
        scans = (size > bound) | (needed(size, t) < SUBSET)
        # entry i meets the following entries of its key whose size is at most size / t, or all of
        # those of other groups
        comp = key.astype(np.uint64) << np.uint64(32) | np.where(shared, 0, size).astype(np.uint64)
        most = np.minimum(np.floor(size / t + 1e-9), 2**31 - 1).astype(np.int32)
        reach = np.maximum(np.searchsorted(comp, key.astype(np.uint64) << np.uint64(32) | most.astype(np.uint64), side="right") - first, 0).astype(np.int32)
        del comp, key, shared
        starts = np.flatnonzero(reach).astype(np.int32)
        total = np.cumsum(reach[starts], dtype=np.int64)
        codes, counts, held, done = [], [], 0, 0
        C.give_back()
        while done < len(starts):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIR_STEP, side="right")))
            s, done = starts[done:stop], stop
            r = reach[s]
            a = np.repeat(s, r)
            b = first[a] + (np.arange(len(a), dtype=np.int32) - np.repeat(np.cumsum(r, dtype=np.int32) - r, r))
            keep = (doc[a] != doc[b]) & (own[a] != own[b]) & ((side[a] == ANY) | (side[a] != side[b])) & (size[a] <= most[b]) & (size[b] <= most[a])
            if kind == 1:  # two enumerating sets meet on their subsets
                keep &= scans[a] | scans[b]
            x, y = at[a[keep]], at[b[keep]]
            del a, b, keep
            c, n = np.unique(np.minimum(x, y) * np.int64(len(ent[0])) + np.maximum(x, y), return_counts=True)
            del x, y
            codes.append(c)
            counts.append(n.astype(np.int32))
            held += len(c)
            del c, n
            if held > 2 * PAIR_STEP:
                c, n = _merge(codes, counts)
                codes, counts, held = [c], [n], len(c)
                if held > PAIR_STEP:
                    codes, counts, held = [], [], 0
                    yield packed(kind, ids, ent, blk, c, n)
                del c, n
                C.give_back()
        if held:
            yield packed(kind, ids, ent, blk, *_merge(codes, counts))

    return run


@C.lean
def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs whose meetings, over all shards, leave a similarity of the threshold possible.

    The group stays packed; of its pairs about two PAIR_STEP are taken out at once, by a hash.
    """
    packed = [r for b in batches for r in zip(b["a"], b["b"], b["need"], b["k"], b["n"])]
    parts = max(1, math.ceil(sum(r[-1] for r in packed) / (2 * PAIR_STEP)))
    for part in range(parts):
        found = []
        for *blobs, _ in packed:
            r = [C.unsqueeze(b, d) for b, d in zip(blobs, (np.int64, np.int64, np.int32, np.int32))]
            if parts > 1:
                own = C.mix(r[0].view(np.uint64) ^ C.mix(r[1].view(np.uint64))) % np.uint64(parts) == part
                r = [x[own] for x in r]
            found.append(r)
        a, b, need, k = (np.concatenate(c) for c in zip(*found))
        del found
        by = np.lexsort((need, b, a))
        a, b, need, k = a[by], b[by], need[by], k[by]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (need[1:] != need[:-1])
        first = np.flatnonzero(new)
        if len(first):
            ok = first[np.add.reduceat(k, first, dtype=np.int64) >= need[first]]
            a, b = a[ok], b[ok]
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
            yield pd.DataFrame({"a": a[new], "b": b[new]})


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while len(bits) * 8 > width:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def _compare_bitmaps(t: float):
    """Pairs that the bitmaps allow: |x ^ y| >= bits that differ, and <= what t permits."""

    @C.lean
    def run(key, maps: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        maps = maps.drop_duplicates("sid").sort_values("sid", kind="stable")
        ids, size = maps["sid"].to_numpy(np.int64), maps["size"].to_numpy(np.int64)
        raw = [np.frombuffer(b, np.uint8) for b in maps["bits"]]
        wide = np.array([len(b) * 8 for b in raw], np.int64)
        if not len(ids):
            return pairs.loc[[], ["a", "b"]]
        x, y = (np.minimum(np.searchsorted(ids, pairs[c].to_numpy(np.int64)), len(ids) - 1) for c in ("a", "b"))
        ok = np.zeros(len(pairs), bool)
        width = np.minimum(wide[x], wide[y])
        for w in np.unique(width):
            of = np.flatnonzero(width == w)
            used, pos = np.unique(np.concatenate([x[of], y[of]]), return_inverse=True)
            m = np.stack([_fold(raw[i], int(w)) for i in used])
            step = max(1, (8 << 20) // m.shape[1])
            for lo in range(0, len(of), step):
                o = of[lo : lo + step]
                differ = np.bitwise_count(m[pos[lo : lo + len(o)]] ^ m[pos[len(of) + lo : len(of) + lo + len(o)]]).sum(1, dtype=np.int64)
                both = size[x[o]] + size[y[o]]
                ok[o[differ <= both - 2 * needed(both, t / (1 + t))]] = True
        return pairs.loc[ok, ["a", "b"]]

    return run


def _near(t: float):
    """The rows (sid, doc_id, text_key, size, bits, grp, of, with) whose bitmap allows a similarity of
    ``t`` with that of the group's first set, as (sid, doc_id, text_key, size, grp)."""

    @C.lean
    def run(batches):
        for b in batches:
            ok = []
            for size, x, of, y in zip(*(b.column(c).to_pylist() for c in ("size", "bits", "of", "with"))):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                w = 8 * min(len(x), len(y))
                ok.append(int(np.bitwise_count(_fold(x, w) ^ _fold(y, w)).sum(dtype=np.int64)) <= size + of - 2 * int(needed(size + of, t / (1 + t))))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok, pa.bool_())) for c in ("sid", "doc_id", "text_key", "size", "grp")], names=["sid", "doc_id", "text_key", "size", "grp"])

    return run


def _all_pairs(t: float):
    """The pairs of sets within a block of a group, or between two, as :func:`_verify` gives them."""

    @C.lean
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid")
        far = (pdf["x"] != pdf["pi"]).to_numpy()
        one = int(pdf["pi"].iloc[0]) == int(pdf["pj"].iloc[0])
        by = np.lexsort((pdf["sid"].to_numpy(), far))
        ids, sets = pdf["sid"].to_numpy()[by], [_unpack(b) for b in pdf["grams"].to_numpy()[by]]
        near = len(ids) if one else int((~far).sum())
        size = np.array([len(g) for g in sets], np.int64)
        start = np.cumsum(size) - size
        every = np.concatenate(sets)
        del sets, pdf
        by = np.argsort(every).astype(np.int32)
        every = every[by]
        at = np.zeros(len(every), np.int32)
        at[by] = np.cumsum(np.append(False, every[1:] != every[:-1]), dtype=np.int32)
        mark = np.zeros(len(every), np.uint8)
        del every, by
        root, links = ids.copy(), np.zeros(len(ids), np.int64)
        for a in range(near):
            lo = a + 1 if one else near
            if lo == len(ids):
                break
            own = at[start[a] : start[a] + size[a]]
            mark[own] = 1
            both = np.add.reduceat(mark[at[start[lo] :]], start[lo:] - start[lo], dtype=np.int64)
            mark[own] = 0
            met = lo + np.flatnonzero(both >= t * (size[a] + size[lo:] - both) - 1e-9)
            links[a] += len(met)
            links[met] += 1
            found = np.unique(np.append(root[met], root[a]))
            if len(found) > 1:
                root[np.isin(root, found)] = found[0]
        ok = links > 0
        return pd.DataFrame({"sid": ids[ok], "root": root[ok], "links": links[ok]})

    return run


def _sets(n: int):
    @C.lean
    def run(batches):
        for b in (x for y in batches for x in C.slices(y, 1)):
            # 40 bits of each hash, still sorted: equal grams stay equal, others collide once in 10^12
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(g >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for g in C.ngram_sets(C.each(b.column(1)), n)], pa.binary())], names=["sid", "grams"])

    return run


def _unpack(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _roots(a: np.ndarray, b: np.ndarray) -> dict[int, int]:
    """Smallest id reachable over the edges (a, b), by union-find."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(up, up)
            x = up
        return x

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def _verify(t: float):
    """The pairs of a block that reach ``t``, as one row per set: its root and number of links."""

    @C.lean
    def run(key, sets: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        have = {d: _unpack(b) for d, b in zip(sets["sid"], sets["grams"])}
        a, b = pairs["a"].to_numpy(), pairs["b"].to_numpy()
        ok = np.zeros(len(a), bool)
        for i, (p, q) in enumerate(zip(a.tolist(), b.tolist())):
            x, y = have.get(p), have.get(q)
            if x is None or y is None:
                continue
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            at[at == len(y)] = 0
            both = int(np.count_nonzero(y[at] == x))
            ok[i] = both >= t * (len(x) + len(y) - both) - 1e-9
        ids, links = np.unique(np.concatenate([a[ok], b[ok]]), return_counts=True)
        root = _roots(a[ok], b[ok])
        return pd.DataFrame({"sid": ids, "root": np.array([root[x] for x in ids.tolist()], np.int64), "links": links.astype(np.int64)})

    return run


def choose_boundary(hist: list[tuple[int, int]], list_len: float, t: float) -> int:
    """The set size up to which enumerating 2-subsets is no dearer than scanning lists.

    ``hist``: (size, sets) over all sets.  A set of size s costs C(p2, 2) records as subsets, or
    p1 list entries that each meet ``list_len`` others on average; a record is moved and sorted
    (weight 4), a meeting is only counted (weight 1).
    """
    bound = 0
    for s, _ in sorted(hist):
        o = int(needed(s, t))
        p1, p2 = s - o + 1, s - o + SUBSET
        if o >= SUBSET and 4 * p2 * (p2 - 1) / 2 <= p1 * (4 + list_len):
            bound = s
        elif o >= SUBSET:
            break
    return bound


def list_length(sketch: np.ndarray, excess: np.ndarray, t: float) -> float:
    """Others that an entry of a scanned list meets, on average: over the ``1 - t`` of all gram
    occurrences that come first in the order, those of the rarest grams, as the sketch has them."""
    by = np.argsort(excess, kind="stable")
    mass = np.cumsum(sketch[by], dtype=np.float64)
    first = by[: int(np.searchsorted(mass, (1 - t) * mass[-1])) + 1] if mass[-1] else by[:0]
    return float((sketch[first] * excess[first]).sum() / max(1.0, float(sketch[first].sum())))


def _coarse(size):
    """Set sizes as they are up to 4096, above rounded up to 6 leading bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.col(size).cast("double"))) - 6)
    return F.when(F.col(size) <= 4096, F.col(size).cast("long")).otherwise((F.ceil(F.col(size) / step) * step).cast("long"))


def similar_sets(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(rows, links).  ``rows`` (doc_id, text_key, sid) has every document's set, null if it has
    none; equal sets have one sid, which is the smallest doc_id that has the set (a number below
    all doc_ids where that document has several sets).  ``links`` (sid, root, links) says, for
    some blocks of similar pairs, how many of them a set is in and the smallest sid that it
    reaches over them; every pair of similar sets is in one block."""
    spark = docs.sparkSession
    src = C.require(docs, "doc_id", "text").where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    prof = C.table(src.mapInArrow(_profile(n), "doc_id long, text_key long, size int, hi long, lo long, bits binary, bands array<int>, chunk int, blob binary"), "ngram-profile")
    sketch = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, 1 << CHUNK_BITS), np.uint32)
    for r in prof.where("chunk IS NOT NULL").select("chunk", "blob").groupBy("chunk").applyInPandas(_add_chunks, "chunk int, blob binary").collect():
        sketch[r.chunk] = np.frombuffer(r.blob, np.uint32)
    sketch = sketch.reshape(-1)
    mean = max(float(sketch.mean()), 1.0)
    # classes of excess over what unrelated grams in the same cell explain; 0: nothing stands out
    excess = np.maximum(sketch - (mean + 4 * math.sqrt(mean)), 0)
    rank = np.ceil(np.log2(1 + excess)).astype(np.uint8)
    lists = np.minimum(np.ceil(np.maximum(excess, 1) / HOT_LIST), 65535).astype(np.uint16)
    rows, sets = prof.where("chunk IS NULL"), prof.where("size > 0")
    classes = C.table(sets.groupBy("size", "hi", "lo").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.count("*").alias("n")).select("size", "hi", "lo", F.col("r.doc_id").alias("rep"), F.col("r.text_key").alias("rep_key"), "n"), "ngram-classes")
    stats = classes.agg(F.count("*").alias("n"), F.sum(F.expr("CAST(n > 1 AS LONG)")).alias("copied"), F.min("rep").alias("low")).first()
    twice = C.table(classes.groupBy("rep").count().where("count > 1").select("rep"), "ngram-twice")
    n_twice = twice.count()
    sid = classes.withColumn("sid", F.col("rep"))
    named = lambda d, doc: d.withColumn("sid", F.col(doc))
    if n_twice:  # a document with several texts that are the least of their classes
        minted = C.table(classes.join(C.small(twice, n_twice, 8), "rep", "left_semi").select(F.col("rep").alias("m_doc"), F.col("rep_key").alias("m_key"), (F.lit(stats.low - 1) - F.monotonically_increasing_id()).alias("m_sid")), "ngram-minted")
        n_minted = minted.count()

        def named(d, doc, key="text_key"):
            return d.join(C.small(minted, n_minted, 24), (F.col(doc) == F.col("m_doc")) & (F.col(key) == F.col("m_key")), "left").withColumn("sid", F.coalesce("m_sid", doc)).drop("m_doc", "m_key", "m_sid")

        sid = named(classes, "rep", "rep_key")
    copied = sid.where("n > 1").select("size", "hi", "lo", "rep", "rep_key", "sid")
    other = sets.select("doc_id", "text_key", "size", "hi", "lo").join(C.small(copied, int(stats.copied or 0), 44), ["size", "hi", "lo"]).where("doc_id <> rep OR text_key <> rep_key")
    other = C.table(other.select("doc_id", "text_key", "sid").distinct(), "ngram-others")
    n_other = other.count()
    lone = lambda d: named(d.join(C.small(other, n_other, 24), ["doc_id", "text_key"], "left_anti"), "doc_id")
    hist = [(int(r.s), int(r.c)) for r in classes.groupBy(_coarse("size").alias("s")).agg(F.count("*").alias("c")).collect()]
    bound = choose_boundary(hist, list_length(sketch, excess, t), t)
    # what the cut lists repeat, over all occurrences
    cut = float((sketch * lists.astype(np.float64)).sum() / max(1.0, float(sketch.sum())))
    entries = sum(c * (s - int(needed(s, t)) + 1) * cut + (c * (s - int(needed(s, t)) + 2) ** 2 // 2 if s <= bound else 0) for s, c in hist)
    shards = max(4, math.ceil(entries / SHARD_RECORDS))
    order_b = spark.sparkContext.broadcast((rank, lists))
    members, n_members = _groups(lone(sets).select("sid", "doc_id", "text_key", "size", "bits", "bands"), t)
    # what becomes of a text: a copy goes, a member of a group brings it along
    role = other.select("doc_id", "text_key", F.lit(True).alias("gone"), F.lit(None).cast("long").alias("grp")).unionByName(members.select("doc_id", "text_key", F.lit(False).alias("gone"), "grp"))
    texts = src.where("text IS NOT NULL").join(C.small(role, n_other + n_members, 33), ["doc_id", "text_key"], "left").where("gone IS NULL OR NOT gone")
    texts = named(texts, "doc_id").select("sid", "text", "grp")
    grouped = texts.select("sid", "text", F.coalesce("grp", "sid").alias("own"))
    blocks = grouped.mapInArrow(_signatures(n, t, bound, shards, order_b), "shard int, keys binary, docs binary, sizes binary, lasts binary, owns binary")
    met = blocks.groupBy("shard").applyInPandas(_pairs(t, bound, shards), _PACKED)
    cand = C.table(met.groupBy("blk").applyInPandas(_candidates, "a long, b long"), "ngram-candidates")
    grams = max(16, sum(s * c for s, c in hist) // max(1, stats.n))
    close = _by_blocks(cand, lambda ids: lone(sets).select("sid", "size", "bits").join(ids, "sid", "left_semi"), grams // 2, _compare_bitmaps(t), "a long, b long")
    cand = C.table(close, "ngram-close")
    sets_of = lambda ids: texts.join(ids, "sid", "left_semi").mapInArrow(_sets(n), "sid long, grams binary")
    links = C.table(_by_blocks(cand, sets_of, grams * 5, _verify(t), "sid long, root long, links long"), "ngram-links")
    if n_members:
        own = texts.where("grp IS NOT NULL").select("sid", "text").mapInArrow(_sets(n), "sid long, grams binary").join(C.small(members.select("sid", "grp", "blocks"), n_members, 24), "sid")
        own = own.withColumn("x", F.expr("CAST(pmod(xxhash64(sid), blocks) AS INT)")).withColumn("y", F.explode(F.expr("sequence(0, blocks - 1)")))
        own = own.select("sid", "grams", "grp", "x", F.least("x", "y").alias("pi"), F.greatest("x", "y").alias("pj"))
        links = links.unionByName(C.table(own.groupBy("grp", "pi", "pj").applyInPandas(_all_pairs(t), "sid long, root long, links long"), "ngram-grouped"))
    rows = rows.select("doc_id", "text_key", "size").join(C.small(other, n_other, 24), ["doc_id", "text_key"], "left")
    rows = named(rows.withColumnRenamed("sid", "of"), "doc_id")
    return rows.select("doc_id", "text_key", F.when(F.col("size") > 0, F.coalesce("of", "sid")).alias("sid")), links


def _groups(sets: DataFrame, t: float) -> tuple[DataFrame, int]:
    """(members, their number).  ``members`` (sid, doc_id, text_key, grp, blocks): sets that share a
    band with at least DENSE sets, the smallest sid of those that are near, and into how many blocks
    the group is cut.  The first set of a key is near itself, so it is always in a group too."""
    keyed = sets.withColumn("band", F.explode("bands")).drop("bands")
    dense = C.table(keyed.groupBy("band").agg(F.min("sid").alias("grp"), F.count("*").alias("n")).where(F.col("n") >= DENSE).select("band", "grp"), "ngram-dense")
    n_dense = dense.count()
    some = keyed.join(C.small(dense, n_dense, 12), "band").drop("band").dropDuplicates(["sid", "grp"])
    heads = C.table(sets.join(C.small(dense.select(F.col("grp").alias("sid")).distinct(), n_dense, 8), "sid", "left_semi").select(F.col("sid").alias("grp"), F.col("size").alias("of"), F.col("bits").alias("with")).dropDuplicates(["grp"]), "ngram-heads")
    near = some.join(heads, "grp").select("sid", "doc_id", "text_key", "size", "bits", "grp", "of", "with")
    near = near.mapInArrow(_near(t), "sid long, doc_id long, text_key long, size int, grp long")
    near = C.table(near.groupBy("sid").agg(F.min(F.struct("grp", "doc_id", "text_key", "size")).alias("r")).select("sid", "r.*"), "ngram-near")
    groups = near.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("size") * 5 / F.lit(DENSE_BYTES))).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1")
    members = C.table(near.join(C.small(groups, n_dense, 12), "grp").select("sid", "doc_id", "text_key", "grp", "blocks"), "ngram-members")
    return members, members.count()


def _by_blocks(pairs: DataFrame, side, row_bytes: int, check, schema: str) -> DataFrame:
    """Run ``check`` on pairs (a, b) together with the rows that ``side`` gives for their sets.

    Sets fall into blocks, and a set goes once to each pair of blocks in which it has a pair: a
    group's memory is bounded and large groups of similar documents don't multiply rows.
    """
    ids = C.table(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "ngram-met")
    n, n_pairs = ids.count(), pairs.count()
    # a set is in as many groups as there are blocks, or as it has pairs, whichever is less
    blocks = max(2, math.ceil(min(2 * n * row_bytes / VERIFY_BYTES, math.sqrt(4 * n_pairs * row_bytes / VERIFY_BYTES))), math.ceil(math.sqrt(2 * n_pairs / PAIR_STEP)))
    blk = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks)).cast("int")
    pair = pairs.withColumn("ga", F.least(blk("a"), blk("b"))).withColumn("gb", F.greatest(blk("a"), blk("b")))
    where = C.table(pair.select(F.col("ga").alias("pa"), F.col("gb").alias("pb"), F.explode(F.array("a", "b")).alias("sid")).distinct(), "ngram-where")
    placed = side(C.small(ids, n, 8)).join(C.small(where, where.count(), 16), "sid")
    return placed.groupBy("pa", "pb").cogroup(pair.groupBy("ga", "gb")).applyInPandas(check, schema)


def similar_classes(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, class_id, n_links) of every row of ``docs`` with a doc_id; ``text_key``
    is xxhash64 of the text.  See :func:`ngram_jaccard_join` for the rest."""
    rows, links = similar_sets(docs, n, t)
    total = C.table(links.groupBy("sid").agg(F.sum("links").alias("links")), "ngram-degrees")
    roots = C.table(components(links.select(F.col("root").alias("doc_a"), F.col("sid").alias("doc_b"))), "ngram-roots")
    info = total.join(roots.withColumnRenamed("doc_id", "sid"), "sid", "left").select("sid", F.coalesce("root", "sid").alias("root"), "links")
    rows = rows.join(C.small(info, total.count(), 24), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rows = C.table(rows, "ngram-rows")
    minted = rows.groupBy("root").agg(F.min("doc_id").alias("class_id")).where("root < class_id")
    n_minted = minted.count()  # of classes whose root isn't a doc_id
    if n_minted:
        rows = rows.join(C.small(minted, n_minted, 16), "root", "left")
    else:
        rows = rows.withColumn("class_id", F.lit(None).cast("long"))
    return rows.select("doc_id", "text_key", F.coalesce("class_id", "root", "doc_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def ngram_jaccard_join(docs: DataFrame, n: int = NGRAM, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links): every document with its class under the word n-gram Jaccard
    join at ``t``, and its number of links.

    A link joins two different n-gram sets of Jaccard >= ``t``; all are found, none is returned by
    itself, so the result has as many rows as the documents.  n_links counts the other sets that a
    document's set is linked to; documents of equal sets share it, and count as one set for
    others.  class_id is the smallest doc_id that is reached over links and equal sets.  A text
    shorter than n words is one gram; one without any letter or digit, an empty or null text has no
    set: it is a class of its own without links.  Rows with a null doc_id are left out.  Equal rows
    give one row; a doc_id with other texts one for each different class or number of links.  A
    very long text is one set like others, whole.  Sets are compared by 40 bits of each gram's hash,
    equal sets by 128 bits of the set's.  An empty table gives an empty result; other columns of
    ``docs`` are ignored.
    """
    return similar_classes(docs, n, t).select("doc_id", "class_id", "n_links").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(doc_id, root): smallest doc_id reachable over ``edges`` (doc_a, doc_b).

    Alternating large-star and small-star steps (Kiveris et al. 2014); every second step is
    written to the shared folder, which cuts lineage.
    """
    summary = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = C.table(edges.select(F.greatest("doc_a", "doc_b").alias("u"), F.least("doc_a", "doc_b").alias("v")).where("u <> v").distinct(), "star")
    before = summary(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        # every larger neighbour of u goes to the least of u's neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = C.table(small.where("u <> v").distinct(), "star")
        after = summary(e)
        if before == after:
            return e.select(F.col("u").alias("doc_id"), F.col("v").alias("root"))
        before = after
