"""Chunking as table-generating operators over text parts.

Parts are rows (document_id, part_id, ordinal, text, start) with ``start`` the code point at which
the part begins in its document; chunks are rows (document_id, part_id, ordinal, start, end,
text, structural_path, document_domain, chunking_strategy).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import batches as arrow
from ..functions import spans as S
from ..functions.text import PARAGRAPH_TILE, SENTENCE_TILE, trimmed_span

#: Strategies by family; the first is what ``auto`` resolves to.
MATRIX = {
    "text": ("recursive", *(s for s in (*S.GENERIC, *S.STRUCTURED, "table", "evidence") if s != "recursive")),
    "ocr": ("evidence", "layout_region", "table", *S.GENERIC, *S.STRUCTURED),
    "layout": ("evidence", "layout_region", "table", *S.GENERIC, *S.STRUCTURED),
    "vision": ("evidence", "image_region", *S.GENERIC, *S.STRUCTURED),
    "media": ("evidence", "transcript_segment", "scene", *S.GENERIC, *S.STRUCTURED),
}
#: Bytes of text that are cut at once, to bound a worker's memory.
TEXT_BYTES = 1 << 20
_CHUNK = "document_id string, part_id string, part_ordinal int, at int, start int, end int, text string, structural_path string, document_domain string"


def resolve(family: str, policy: S.Policy | None = None) -> S.Policy:
    """The policy with ``auto`` made concrete; an unknown or unfit strategy is an error."""
    policy = policy or S.Policy("auto")
    if family not in MATRIX:
        raise ValueError(f"{family!r} is no content family")
    strategy = MATRIX[family][0] if policy.strategy == "auto" else policy.strategy
    if strategy not in MATRIX[family]:
        raise ValueError(f"strategy {strategy!r} doesn't suit {family}")
    return S.Policy(strategy, policy.max_chars, policy.overlap_chars, policy.min_chunk_chars, policy.semantic_threshold, policy.include_parent_context)


def guard(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more than ``most``: never a truncation."""
    n = rows.limit(most + 1).count()
    if n > most:
        raise OverflowError(f"the limit of {most} chunks would cut some off")
    return rows


def chunk_text(parts: DataFrame, policy: S.Policy) -> DataFrame:
    """Any textual strategy, in Arrow batches; ordinals run across the parts of a document."""
    policy = resolve("text", policy)
    declared = "document_domain" in parts.columns

    def spans_of(doc, part, order, text, start, dom):
        label = S.domain(policy.strategy, dom)
        return ((doc, part, order, i, start + lo, start + hi, text[lo:hi], path, label) for i, (lo, hi, path) in enumerate(S.spans(text, policy, part)))

    src = parts.select(F.col("document_id").cast("string"), "part_id", F.col("ordinal").cast("int"), "text", F.col("start").cast("int"), (F.col("document_domain") if declared else F.lit(None).cast("string")).alias("document_domain"))
    return _numbered(_cut(src, spans_of), policy.strategy)


def chunk_structure(parts: DataFrame, max_chars: int = 800) -> DataFrame:
    """The structure-aware chunker: paragraphs within ``max_chars`` under the headings open there."""
    if max_chars <= 0:
        raise ValueError("a chunk needs room for at least one character")

    def spans_of(doc, part, order, text, start):
        return ((doc, part, order, i, start + lo, start + hi, text[lo:hi], path, "text") for i, (lo, hi, path) in enumerate(S.structured(text, max_chars, part)))

    src = parts.select(F.col("document_id").cast("string"), "part_id", F.col("ordinal").cast("int"), "text", F.col("start").cast("int"))
    return _numbered(_cut(src, spans_of), "structure_aware")


def _cut(parts: DataFrame, spans_of) -> DataFrame:
    """The chunks ``spans_of(*row)`` of every part."""
    return parts.where("text IS NOT NULL").mapInArrow(_cutter(spans_of), _CHUNK)


def _cutter(spans_of, limit: int | None = None):
    """Batches of parts to batches of their chunks, of about ``limit`` bytes of text at a time: what a
    whole batch of parts becomes is many times its size as Python objects."""
    limit = limit or TEXT_BYTES
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32()}[t]) for n, t in (c.split() for c in _CHUNK.split(", "))])

    @arrow.lean
    def run(batches):
        for b in (x for y in batches for x in arrow.portions(y, arrow.text_bytes(y.column(3)), limit)):
            cols = tuple(zip(*(r for row in zip(*(c.to_pylist() for c in b.columns)) for r in spans_of(*row)))) or [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types)], schema=schema)

    return run


def _numbered(chunks: DataFrame, strategy: str) -> DataFrame:
    w = W.partitionBy("document_id").orderBy("part_ordinal", "at")
    return chunks.select("document_id", "part_id", (F.row_number().over(w) - 1).alias("ordinal"), "start", "end", "text", "structural_path", "document_domain", F.lit(strategy).alias("chunking_strategy"))


# --- strategies whose boundaries don't depend on each other, inside the JVM -------------------


def windows(text: Column, size: int, step: int | None = None) -> Column:
    """array<struct(start, end, text)>: trimmed windows, blank ones left out; with ``step`` below
    ``size`` the last is the first to reach the end and a repeat of the one before is dropped."""
    n = F.length(text)
    step = step or size
    last = F.greatest(F.lit(0), n - 1) if step == size else F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int") * step)
    starts = F.when(n > 0, F.sequence(F.lit(0), last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: trimmed_span(F.substring(text, i + 1, F.lit(size)), i))
    full = F.filter(cut, lambda s: F.length(s["text"]) > 0)
    if step == size:
        return full
    # the outer transform binds the array, which a lambda would otherwise compute for every element
    new = lambda f: F.filter(f, lambda s, i: (i == 0) | (s["start"] != F.get(f, i - 1)["start"]) | (s["end"] != F.get(f, i - 1)["end"]))
    return F.get(F.transform(F.array(full), new), F.lit(0))


def _bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, where a lambda would compute it for every element."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Elements that are summed or held together, so that long arrays cost no quadratic time.
_RUN = 64


def _before(sizes: Column) -> Column:
    """array<int>: the sum of the sizes before each one."""
    add = lambda a, x: a + x
    part = lambda b: F.aggregate(F.slice(sizes, b * _RUN + 1, F.lit(_RUN)), F.lit(0), add)
    sums = F.when(F.size(sizes) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / _RUN).cast("int")), part)).otherwise(F.array().cast("array<int>"))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    heads = F.aggregate(sums, seed, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]
    inside = lambda i: F.aggregate(F.slice(sizes, i - i % _RUN + 1, i % _RUN), F.lit(0), add)
    return _bind(heads, lambda h: F.transform(sizes, lambda x, i: F.get(h, F.floor(i / _RUN).cast("int")) + inside(i)))


def tiles(text: Column, pattern: str = SENTENCE_TILE) -> Column:
    """array<struct(start, end, text)>: trimmed tiles of a text that together cover it."""
    raw = F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda t: t != "")
    at = lambda r: _bind(F.transform(r, F.length), _before)
    placed = _bind(raw, lambda r: _bind(at(r), lambda b: F.transform(r, lambda t, i: trimmed_span(t, F.get(b, i)))))
    return F.filter(placed, lambda s: F.length(s["text"]) > 0)


def explode_spans(docs: DataFrame, spans: Column, *keep: str) -> DataFrame:
    out = docs.select(*keep, F.posexplode(spans).alias("ordinal", "s"))
    return out.select(*keep, "ordinal", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))


def packed(units: Column, limit: int) -> Column:
    """array<struct(start, end)>: greedy packing of units none of which exceeds ``limit``."""
    span = "struct<start:int,end:int>"
    bare = F.transform(units, lambda u: F.struct(u["start"].alias("start"), u["end"].alias("end")))
    seed = F.struct(F.lit(None).cast(span).alias("open"), F.array().cast(f"array<{span}>").alias("few"), F.array().cast(f"array<array<{span}>>").alias("many"))

    def step(a, u):
        grown = F.struct(F.struct(a["open"]["start"].alias("start"), u["end"].alias("end")).alias("open"), a["few"].alias("few"), a["many"].alias("many"))
        full = F.size(a["few"]) >= _RUN
        few = F.concat(F.when(full, F.array().cast(f"array<{span}>")).otherwise(a["few"]), F.array(a["open"]))
        fresh = F.struct(u.alias("open"), F.when(a["open"].isNull(), a["few"]).otherwise(few).alias("few"), F.when(full, F.concat(a["many"], F.array(a["few"]))).otherwise(a["many"]).alias("many"))
        return F.when(a["open"].isNotNull() & (u["end"] - a["open"]["start"] <= limit), grown).otherwise(fresh)

    end = lambda a: F.concat(F.flatten(a["many"]), a["few"], F.when(a["open"].isNotNull(), F.array(a["open"])).otherwise(F.array().cast(f"array<{span}>")))
    return F.aggregate(bare, seed, step, end)


PARAGRAPHS, SENTENCES = PARAGRAPH_TILE, SENTENCE_TILE
