"""Lexical and dense retrieval over batches of queries, fusion, reranking, canonical top-k.

Queries are a DataFrame (query_id, query); results are (query_id, chunk_id, relevance, rank) in
the total order relevance descending, chunk_id ascending.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import batches as arrow
from ..functions.text import HASHED, tokens, with_tokens
from ..session import written
from . import filters
from .sparse_index import SparseIndex

K1, B = 1.2, 0.75
RRF_K, MULTIPLIER = 60, 4
#: Largest counted side, in rows of at most some 150 bytes in a hash table, that is broadcast; beyond
#: it the join shuffles.
BROADCAST_ROWS = 200_000
#: Distinct query terms up to which they are looked up in place; beyond that they are joined.
LOOKUP_TERMS = 4096
#: Terms of a batch of queries, counted once for each query, up to which the chunks are scored where they lie.
LOCAL_TERMS = 1 << 19
#: Queries by hash embedding up to which the chunks are scored where they lie.
LOCAL_QUERIES = 1 << 14
#: Queries of a dense search up to which the batch is broadcast.
BROADCAST_QUERIES = 1024
#: Vectors of a block of dense_blocks, and queries whose scores are held at once.
BLOCK_VECTORS, STEP = 4096, 256


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def eligible(chunks: DataFrame, where=None) -> DataFrame:
    """Chunks that a metadata filter admits; statistics are always taken after this."""
    return chunks if where is None else chunks.where(filters.compile_filter(where, filters.ColumnFields(chunks)))


def tokenized(chunks: DataFrame) -> DataFrame:
    return with_tokens(chunks, "text", "terms", keep=("chunk_id",)).withColumn("dl", F.size("terms"))


def distinct_ids(chunks: DataFrame) -> bool:
    """Whether each chunk has an id of its own, so that all that is said of an id is in one row."""
    return chunks.groupBy("chunk_id").count().where("count > 1 OR chunk_id IS NULL").isEmpty()


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """(n, avgdl) over all eligible chunks, those without tokens included."""
    return tokenized(chunks).agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl), one row per distinct term of a chunk; counted in the batch where the
    chunk lies, as long as no two rows share an id."""
    tok = tokenized(chunks)
    if not distinct_ids(chunks):
        return tok.select("chunk_id", "dl", F.explode("terms").alias("term")).groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))

    @arrow.lean
    def run(batches):
        for b in arrow.by_tokens(batches, 1):
            row, code, words = arrow.coded(b.column(1))
            row, code, n = arrow.counts(row, code, len(words))
            yield pa.RecordBatch.from_arrays([words.take(pa.array(code)), b.column(0).take(pa.array(row)), pa.array(arrow.lengths(b.column(1))[row], pa.int32()), pa.array(n, pa.int64())], names=["term", "chunk_id", "dl", "tf"])

    return tok.select("chunk_id", "terms").mapInArrow(run, f"term string, chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, dl int, tf long")


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qf, qpos): distinct terms in order of first use, with their frequency."""
    t = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "term"))
    return t.groupBy("query_id", "term").agg(F.count("*").alias("qf"), F.min("pos").alias("qpos"))


def top_k(scored: DataFrame, k: int, by: str = "relevance") -> DataFrame:
    """The k best of each query with their rank from 1; Spark limits inside each partition first."""
    if k <= 0:
        raise ValueError("k must be positive")
    order = W.partitionBy("query_id").orderBy(F.desc(by), F.asc("chunk_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@dataclass(frozen=True)
class TermCounts:
    """``rows`` (chunk_id, dl, terms, tfs): how often each chunk, without terms too, has which of
    ``vocabulary``, and its length; ``n`` chunks of ``avgdl`` tokens, ``df`` of them with a term."""

    rows: DataFrame
    vocabulary: dict[str, int]
    n: int
    avgdl: float
    df: np.ndarray


def term_counts(chunks: DataFrame, vocabulary: list[str]) -> TermCounts:
    """One reading of the texts, whose ids are distinct; what is kept of a chunk doesn't leave its
    batch, so nothing is shuffled but a sum for each term."""
    words = {t: i for i, t in enumerate(dict.fromkeys(vocabulary))}
    wanted, width = pa.array(list(words), pa.string()), len(words)

    @arrow.lean
    def count(batches):
        for b in arrow.by_tokens(batches, 1):
            row, code, found = arrow.coded(b.column(1))
            code = pc.fill_null(pc.index_in(found, wanted), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            row, code, n = arrow.counts(row[code >= 0], code[code >= 0], width)
            ends = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (code, n)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(arrow.lengths(b.column(1)), pa.int32()), *lists], names=["chunk_id", "dl", "terms", "tfs"])

    def sums(batches):
        total, df = np.zeros(2, np.int64), np.zeros(width, np.int64)
        for b in batches:
            total += (b.num_rows, int(b.column(0).to_numpy().sum()))
            df += np.bincount(b.column(1).flatten().to_numpy(), minlength=width)[:width]
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-2, -1], at]), pa.int32()), pa.array(np.concatenate([total, df[at]]), pa.int64())], names=["term", "n"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    rows = written(tokenized(chunks).select("chunk_id", "terms").mapInArrow(count, f"chunk_id {kind}, dl int, terms array<int>, tfs array<int>"), "counts")
    said = {r.term: r.n for r in rows.select("dl", "terms").mapInArrow(sums, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = said.get(-2, 0)
    return TermCounts(rows, words, n, said.get(-1, 0) / n if n else 0.0, np.array([said.get(i, 0) for i in range(width)], np.int64))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def _bm25_local(counts: TermCounts, terms: list, k: int, k1: float, b: float, query_kind: pa.DataType, schema: str) -> DataFrame:
    """The k best of each query: each task scores its chunks for all queries and hands on k of each.

    ``terms``: rows of :func:`query_terms`.  The sums go by ``qpos``, as those of :func:`bm25` do.
    """
    spark = counts.rows.sparkSession
    dfs = sorted({int(x) for x in counts.df if x})
    made = spark.createDataFrame([(x,) for x in dfs], "df long").select("df", _idf(F.lit(counts.n), F.col("df")).alias("idf")).collect() if dfs else []
    idf = {r.df: r.idf for r in made}
    parts: dict[tuple[int, float], int] = {}  # (term, weight) and its number
    asked: dict[object, list[int]] = {}
    for r in sorted(terms, key=lambda r: r.qpos):
        t = counts.vocabulary[r.term]
        if counts.df[t]:
            asked.setdefault(r.query_id, []).append(parts.setdefault((t, r.qf * idf[int(counts.df[t])]), len(parts)))
    queries = pa.array(list(asked), query_kind)
    sums, pairs = [np.array(v, np.int32) for v in asked.values()], list(parts)
    avgdl, id_kind, width = counts.avgdl, arrow.kind(counts.rows, "chunk_id"), len(counts.vocabulary)

    @arrow.lean
    def run(batches):
        best = arrow.Best(len(sums), k)
        for x in batches:
            ids, of = x.column(0).to_numpy(zero_copy_only=False), arrow.lengths(x.column(2))
            term, tf = (x.column(c).flatten().to_numpy() for c in (2, 3))
            order = np.argsort(term, kind="stable")
            row, tf = np.repeat(np.arange(len(ids)), of)[order], tf[order].astype(np.float64)
            lo = np.searchsorted(term[order], np.arange(width + 1))
            room = k1 * (1 - b + b * x.column(1).to_numpy() / avgdl) if avgdl > 0 else np.full(len(ids), k1 * (1 - b))
            below = tf + room[row]
            held = [None] * len(pairs)
            for i, (t, w) in enumerate(pairs):
                if lo[t] < lo[t + 1]:
                    at = slice(lo[t], lo[t + 1])
                    held[i] = row[at], w * tf[at] * (k1 + 1) / below[at]
            for q, numbers in enumerate(sums):
                score = np.zeros(len(ids))
                for i in numbers:
                    if held[i] is not None:
                        score[held[i][0]] += held[i][1]
                best.offer(q, ids, score, np.flatnonzero(score > 0))
        yield from best.batches(queries, id_kind)

    return top_k(counts.rows.mapInArrow(run, schema), k)


def bm25(chunks: DataFrame, queries: DataFrame, k: int | None = None, where=None, k1: float = K1, b: float = B, index: SparseIndex | TermCounts | DataFrame | None = None) -> DataFrame:
    """Okapi BM25 with statistics over the chunks that pass ``where``; scores above 0 only.

    Only terms of the query batch are exploded and shuffled, and none where ``k`` is given and the
    batch has at most ``LOCAL_TERMS``.  ``index``: a written index, which spares the texts of ``chunks``
    another reading, their counts of the terms of the queries, or postings alone.
    """
    if k is not None and k <= 0:
        raise ValueError("k must be positive")
    admitted = eligible(chunks, where)
    qt = query_terms(queries)
    if k is not None and (index is None or isinstance(index, TermCounts)):
        terms = qt.limit(LOCAL_TERMS + 1).collect()
        fresh = index is None or where is not None
        if len(terms) <= LOCAL_TERMS and (not fresh or distinct_ids(admitted)):
            counts = term_counts(admitted, [r.term for r in terms]) if fresh else index
            kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (chunks, "chunk_id"))]
            return _bm25_local(counts, terms, k, k1, b, arrow.kind(queries, "query_id"), f"query_id {kinds[0]}, chunk_id {kinds[1]}, relevance double")
    index = None if isinstance(index, TermCounts) else index
    vocabulary = [r.term for r in qt.select("term").distinct().limit(LOOKUP_TERMS + 1).collect()]
    few = len(vocabulary) <= LOOKUP_TERMS
    n_rows = qt.count()
    wanted = small(qt.select("term").distinct(), n_rows)
    if index is None:
        stats = corpus_stats(admitted)
        tok = tokenized(admitted)
        if few:  # other terms are dropped before anything is exploded
            tok = tok.select("chunk_id", "dl", F.filter("terms", lambda t: t.isin(vocabulary)).alias("terms"))
            used = tok.select("chunk_id", "dl", F.explode("terms").alias("term"))
        else:
            used = tok.select("chunk_id", "dl", F.explode("terms").alias("term")).join(wanted, "term", "left_semi")
        hits = used.groupBy("term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    else:
        whole = isinstance(index, SparseIndex)
        lengths = index.lengths() if whole else None
        hits = index.postings(vocabulary if few else None) if whole else index
        hits = hits if whole and few else hits.join(wanted, "term", "left_semi")
        if where is not None:
            ids = admitted.select("chunk_id")
            hits = hits.join(ids, "chunk_id", "left_semi")
            lengths = lengths.join(ids, "chunk_id", "left_semi") if whole else None
        stats = lengths.agg(F.count("*").alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")) if whole else corpus_stats(admitted)
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    part = hits.join(small(df, n_rows), "term").join(small(qt, n_rows), "term").crossJoin(F.broadcast(stats))
    share = F.when(F.col("avgdl") > 0, b * F.col("dl") / F.col("avgdl")).otherwise(F.lit(0.0))
    score = F.col("qf") * _idf(F.col("n"), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + share))
    part = part.select("query_id", "chunk_id", "qpos", score.alias("s"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("qpos", "s"))), F.lit(0.0), lambda acc, x: acc + x["s"])
    scored = part.groupBy("query_id", "chunk_id").agg(total.alias("relevance")).where("relevance > 0")
    return scored if k is None else top_k(scored, k)


def with_contents(ranked: DataFrame, chunks: DataFrame, most: int) -> DataFrame:
    """``ranked``, of at most ``most`` rows, with the columns of its chunks; while those are few it is
    the results that travel, not the texts of the corpus."""
    return chunks.join(small(ranked, most), "chunk_id")


def _hashed(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ts): the tokens that are hashed, of each id in one row."""
    t = with_tokens(chunks, "text", "ts", HASHED, keep=("chunk_id",))
    return t if distinct_ids(chunks) else t.groupBy("chunk_id").agg(F.flatten(F.collect_list("ts")).alias("ts"))


def hash_embedding_cells(chunks: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, i, value): the signed feature hash of each text, L2 normalised, zeros left out.

    A text whose tokens cancel out or that has none becomes the first unit vector.
    """

    @arrow.lean
    def run(batches):
        hashed = arrow.Hashed(dim)
        for b in arrow.by_tokens(batches, 1, dim):
            x = hashed.matrix(b.column(1))
            row, i = np.nonzero(x)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(i, pa.int32()), pa.array(x[row, i], pa.float64())], names=["chunk_id", "i", "value"])

    return _hashed(chunks).mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, i int, value double")


def hash_embeddings(chunks: DataFrame, dim: int) -> DataFrame:
    """(chunk_id, vec): the cells as dense unit vectors of doubles."""

    @arrow.lean
    def run(batches):
        hashed = arrow.Hashed(dim)
        for b in arrow.by_tokens(batches, 1, dim):
            ends = pa.array(np.arange(b.num_rows + 1) * dim, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(hashed.matrix(b.column(1)).ravel()))], names=["chunk_id", "vec"])

    return _hashed(chunks).mapInArrow(run, f"chunk_id {chunks.schema['chunk_id'].dataType.simpleString()}, vec array<double>")


def hash_nearest(chunks: DataFrame, queries: DataFrame, k: int, dim: int, digits: int = 9) -> DataFrame:
    """The k nearest texts of each query (query_id, query) by the dot product of their hash
    embeddings, rounded to ``digits``.

    Each task embeds its texts, multiplies them with all queries and hands on k of each; no vector
    is written or sent.  More than ``LOCAL_QUERIES`` queries meet the vectors in blocks.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    asked = hash_embeddings(queries.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text")), dim).select(F.col("chunk_id").alias("query_id"), F.col("vec").alias("qvec"))
    rows = asked.limit(LOCAL_QUERIES + 1).collect()
    if len(rows) > LOCAL_QUERIES or not distinct_ids(chunks):
        return dense_blocks(hash_embeddings(chunks, dim), asked, k, digits)
    q_ids, q = pa.array([r.query_id for r in rows], arrow.kind(queries, "query_id")), np.array([r.qvec for r in rows], np.float64).reshape(len(rows), dim)
    id_kind = arrow.kind(chunks, "chunk_id")

    @arrow.lean
    def run(batches):
        hashed, best = arrow.Hashed(dim), arrow.Best(len(q), k)
        for b in arrow.by_tokens(batches, 1, dim):
            ids, x = b.column(0).to_numpy(zero_copy_only=False), hashed.matrix(b.column(1))
            for lo in range(0, len(q), STEP):
                for i, s in enumerate(np.round(q[lo : lo + STEP] @ x.T, digits), lo):
                    best.offer(i, ids, s, np.flatnonzero(s >= best.least[i]))
        yield from best.batches(q_ids, id_kind)

    kinds = [d.schema[c].dataType.simpleString() for d, c in ((queries, "query_id"), (chunks, "chunk_id"))]
    return top_k(_hashed(chunks).mapInArrow(run, f"query_id {kinds[0]}, chunk_id {kinds[1]}, relevance double"), k)


def model_embeddings(chunks: DataFrame, embed: Callable[[list[str]], np.ndarray], dim: int) -> DataFrame:
    """(chunk_id, vec): unit vectors of a model, ``embed(texts)`` giving a row of ``dim`` numbers for each.

    The function runs in Python workers, on Arrow batches; what isn't finite, has no length or
    another dimension is an error.
    """
    kind = chunks.schema["chunk_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            v = np.asarray(embed([t or "" for t in b.column(1).to_pylist()]), np.float64)
            if v.shape != (b.num_rows, dim) or not np.isfinite(v).all():
                raise ValueError(f"the model must give {dim} finite numbers for each text")
            n = np.linalg.norm(v, axis=1, keepdims=True)
            if (n == 0).any():
                raise ValueError("a vector has no direction")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(v / n), pa.list_(pa.float64()))], names=["chunk_id", "vec"])

    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {kind}, vec array<double>")


def no_embeddings(chunks: DataFrame) -> DataFrame:
    """The embedder of an index without vectors: asking it is an error."""
    raise NotImplementedError("this index is lexical; there are no vectors")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector as doubles of length 1; null if it has no direction."""
    d = F.transform(v, lambda x: x.cast("double"))
    n = F.sqrt(dot(d, d))
    return F.when(n > 0, F.transform(d, lambda x: x / n))


def require_unit(v: Column, tolerance: float = 1e-9) -> Column:
    """The vector, or an error if its length isn't 1."""
    n = F.sqrt(dot(v, v))
    ok = F.abs(n - 1) <= tolerance * F.greatest(n, F.lit(1.0))
    return F.when(ok, v).otherwise(F.raise_error(F.lit("a vector is not of unit length")))


def dense(vectors: DataFrame, queries: DataFrame, k: int, where=None, metric: str = "dot") -> DataFrame:
    """Exact k nearest of each query (query_id, qvec) among unit vectors (chunk_id, vec).

    Scores of zero and below stay.  ``cosine_distance`` gives relevance = -distance and keeps the
    distance as raw_score.  A batch of few queries is broadcast; a larger one meets the vectors in
    blocks (see :func:`dense_blocks`), with products rounded to 12 digits in either case.
    """
    n = queries.count()
    x = eligible(vectors, where)
    if n <= BROADCAST_QUERIES:
        pair = x.crossJoin(F.broadcast(queries)).select("query_id", "chunk_id", F.round(dot(F.col("vec"), F.col("qvec")), 12).alias("d"))
    else:
        pair = dense_blocks(x, queries, k).select("query_id", "chunk_id", F.col("relevance").alias("d"))
    if metric == "cosine_distance":
        scored = pair.select("query_id", "chunk_id", (1 - F.col("d")).alias("raw_score")).withColumn("relevance", -F.col("raw_score"))
    else:
        scored = pair.select("query_id", "chunk_id", F.col("d").alias("relevance"))
    return top_k(scored, k)


def _block_best(k: int, digits: int, step: int):
    def run(key, x: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(q):
            ids, xs = x["chunk_id"].to_numpy(), np.stack(x["vec"].to_numpy())
            q_ids, qs = q["query_id"].to_numpy(), np.stack(q["qvec"].to_numpy())
            for lo in range(0, len(qs), step):
                for i, s in zip(q_ids[lo : lo + step], qs[lo : lo + step] @ xs.T):
                    # all that may round to the k-th best or more
                    at = np.flatnonzero(s >= np.partition(s, -k)[-k] - 10.0**-digits) if len(s) > k else np.arange(len(s))
                    r = np.round(s[at], digits)
                    best = np.lexsort((ids[at], -r))[:k]
                    out.append((np.full(len(best), i), ids[at[best]], r[best]))
        columns = [np.concatenate(c) for c in zip(*out)] or [[], [], []]
        return pd.DataFrame(dict(zip(("query_id", "chunk_id", "relevance"), columns)))

    return run


def dense_blocks(vectors: DataFrame, queries: DataFrame, k: int, digits: int = 12, block: int = BLOCK_VECTORS) -> DataFrame:
    """:func:`dense` by dot product for as many queries as there are vectors.

    Every block of queries meets every block of vectors in a matrix product, which keeps k of
    each query, so no table of all pairs arises.  Vectors are of one length; null ones neither
    ask nor are found.  Products are rounded to ``digits``, so that equal vectors tie.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    x, q = vectors.where("vec IS NOT NULL"), queries.where("qvec IS NOT NULL")
    nx, nq = (max(1, -(-t.count() // block)) for t in (x, q))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    x = x.select("chunk_id", "vec", part("chunk_id", nx).alias("xb"), every(nq).alias("qb"))
    q = q.select("query_id", "qvec", part("query_id", nq).alias("qb")).withColumn("xb", every(nx))
    kinds = [t.schema[c].dataType.simpleString() for t, c in ((q, "query_id"), (x, "chunk_id"))]
    best = x.groupBy("xb", "qb").cogroup(q.groupBy("xb", "qb")).applyInPandas(_block_best(k, digits, STEP), f"query_id {kinds[0]}, chunk_id {kinds[1]}, relevance double")
    return top_k(best, k)


def rrf(sources: list[DataFrame], k: int, rank_constant: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion: sum of 1 / (constant + rank), and each source's score in order."""
    every = None
    for i, s in enumerate(sources):
        s = s.select("query_id", "chunk_id", "rank", F.struct(F.lit(i).alias("source"), "relevance", "rank").alias("from"))
        every = s if every is None else every.unionByName(s)
    ordered = F.array_sort(F.collect_list("from"))
    fused = every.groupBy("query_id", "chunk_id").agg(ordered.alias("prior_scores"))
    total = F.aggregate("prior_scores", F.lit(0.0), lambda a, x: a + F.lit(1.0) / (x["rank"] + rank_constant))
    return top_k(fused.withColumn("relevance", total), k)


#: How each kind of search turns its raw score into relevance.
SCORES = {"bm25": ("sparse", "identity"), "dot": ("dense", "identity"), "cosine": ("dense", "identity"), "cosine_distance": ("dense", "negate"), "rrf": ("fused", "identity"), "overlap": ("reranked", "identity")}


def with_provenance(ranked: DataFrame, metric: str) -> DataFrame:
    """``ranked`` with ``provenance`` (kind, metric, conversion, raw_score)."""
    if metric not in SCORES:
        raise ValueError(f"{metric!r} is no metric")
    kind, conversion = SCORES[metric]
    raw = -F.col("relevance") if conversion == "negate" else F.col("relevance")
    return ranked.withColumn("provenance", F.struct(F.lit(kind).alias("kind"), F.lit(metric).alias("metric"), F.lit(conversion).alias("conversion"), raw.alias("raw_score")))


def depth(k: int, multiplier: int = MULTIPLIER, most: int | None = None) -> int:
    """How many candidates each source of a fusion is asked for."""
    if most is not None and k * multiplier > most:
        raise ValueError(f"{k * multiplier} candidates exceed the limit of {most}")
    return k * multiplier


def rrf_conflicts(ranked: DataFrame, content: str = "text") -> DataFrame:
    """(query_id, chunk_id, n_rows, n_contents) of ids that come twice in one source
    (``source`` column) or with different contents across sources."""
    g = ranked.groupBy("query_id", "chunk_id").agg(F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_sources"), F.countDistinct(content).alias("n_contents"))
    return g.where("n_rows > n_sources OR n_contents > 1").select("query_id", "chunk_id", "n_rows", "n_contents")


def rerank(ranked: DataFrame, k: int, score: Column | None = None) -> DataFrame:
    """Order again by ``score`` (the present relevance if None), cut to k and renumber; the score
    before is put at the head of the history."""
    prior = F.array(F.struct(F.col("relevance"), F.col("rank")))
    out = ranked.withColumn("before", prior).withColumn("relevance", F.col("relevance") if score is None else score)
    return top_k(out.drop("rank"), k)


def overlap_score(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: share of the query's terms in the text."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(text))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, t)) / F.size(q))


def invalid_ranking(ranked: DataFrame, most: int) -> DataFrame:
    """(query_id, reason) of result lists that aren't bounded, unique, contiguous and ordered."""
    w = W.partitionBy("query_id").orderBy("rank")
    r = ranked.withColumn("p", F.lag(F.struct("relevance", "chunk_id")).over(w)).withColumn("at", F.row_number().over(w))
    bad = (F.col("p.relevance") < F.col("relevance")) | ((F.col("p.relevance") == F.col("relevance")) & (F.col("p.chunk_id") >= F.col("chunk_id")))
    g = r.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("u"), F.max(F.coalesce(bad, F.lit(False))).alias("bad"), F.max(F.col("at") != F.col("rank")).alias("gap"))
    reason = F.when(F.col("n") > most, "too many").when(F.col("u") < F.col("n"), "repeated").when(F.col("gap"), "ranks not contiguous").when(F.col("bad"), "out of order")
    return g.select("query_id", reason.alias("reason")).where("reason IS NOT NULL")


def outside(reranked: DataFrame, candidates: DataFrame) -> DataFrame:
    """Reranked rows that weren't candidates; must be empty."""
    return reranked.join(candidates, ["query_id", "chunk_id"], "left_anti")


