"""Chunking of OCR, layout, vision and media evidence: whole parts, joined by their relations.

Parts are rows (document_id, ordinal, part_id, text, locator, relations); ``locator`` is a struct
with ``kind``, ``page``, ``y0``, ``y1``, ``sheet`` and ``start_row``; ``relations`` an array of
struct(target_part_id, kind).  Groups are rows (document_id, ordinal, part_ids, text).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import spans as S


def _links(parts: DataFrame, kind: str | None = None) -> DataFrame:
    """(document_id, part_id, pos, target_part_id): distinct targets in order of first mention."""
    r = parts.select("document_id", "part_id", F.posexplode("relations").alias("pos", "r"))
    if kind:
        r = r.where(F.col("r.kind") == kind)
    r = r.where("r.target_part_id <> part_id").groupBy("document_id", "part_id", F.col("r.target_part_id").alias("target_part_id"))
    return r.agg(F.min("pos").alias("pos"))


def labels(parts: DataFrame) -> DataFrame:
    """Parts that only label others and so are no chunk of their own."""
    r = parts.select("document_id", F.explode("relations").alias("r")).where("r.kind = 'labeled_by'")
    return r.select("document_id", F.col("r.target_part_id").alias("part_id")).distinct()


def _with_related(parts: DataFrame, kind: str | None) -> DataFrame:
    """Unlabelled parts with ``rel``: their related parts (pos, part_id, text), in order."""
    target = parts.select("document_id", F.col("part_id").alias("target_part_id"), F.col("text").alias("t"))
    rel = _links(parts, kind).join(target, ["document_id", "target_part_id"]).groupBy("document_id", "part_id").agg(F.array_sort(F.collect_list(F.struct("pos", "target_part_id", "t"))).alias("rel"))
    own = parts.join(labels(parts), ["document_id", "part_id"], "left_anti")
    empty = F.array().cast("array<struct<pos:int,target_part_id:string,t:string>>")
    return own.join(rel, ["document_id", "part_id"], "left").withColumn("rel", F.coalesce("rel", empty))


def _renumber(groups: DataFrame, by: str) -> DataFrame:
    w = W.partitionBy("document_id").orderBy(by)
    return groups.withColumn("ordinal", F.row_number().over(w) - 1).select("document_id", "ordinal", "part_ids", "text")


def regions(parts: DataFrame) -> DataFrame:
    """layout_region, image_region, transcript_segment and evidence: one chunk for each part that
    is no label; its related texts come first, then its own."""
    p = _with_related(parts, None)
    text = F.array_join(F.concat(F.transform("rel", lambda x: x["t"]), F.array("text")), " ")
    ids = F.concat(F.array("part_id"), F.transform("rel", lambda x: x["target_part_id"]))
    return _renumber(p.select("document_id", F.col("ordinal").alias("o"), ids.alias("part_ids"), text.alias("text")), "o")


evidence = regions


def evidence_segments(parts: DataFrame, max_chars: int = 800) -> DataFrame:
    """:func:`regions`, each cut into pieces of at most ``max_chars`` that all point to its parts."""
    if max_chars <= 0:
        raise ValueError("a chunk needs room for at least one character")

    def run(batches):
        for b in batches:
            rows = [{"document_id": d, "o": o, "at": i, "part_ids": ids, "text": t} for d, o, ids, text in zip(*(c.to_pylist() for c in b.columns)) for i, t in enumerate(S.segments(text, max_chars))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("document_id", pa.string()), ("o", pa.int32()), ("at", pa.int32()), ("part_ids", pa.list_(pa.string())), ("text", pa.string())]))

    cut = regions(parts).select("document_id", "ordinal", "part_ids", "text").mapInArrow(run, "document_id string, o int, at int, part_ids array<string>, text string")
    w = W.partitionBy("document_id").orderBy("o", "at")
    return cut.select("document_id", (F.row_number().over(w) - 1).alias("ordinal"), "part_ids", "text")


def table_rows(parts: DataFrame) -> DataFrame:
    """Rows of cells by (sheet, row), of boxes by (page, y0, y1); a page locator is its own row.
    Cells read ``labels: value`` and join with `` | ``; rows in order of their first part."""
    p = _with_related(parts, "labeled_by")
    kind = F.col("locator.kind")
    key = F.when(kind == "cell", F.concat_ws("\x1f", F.lit("cell"), "locator.sheet", "locator.start_row")).when(kind == "box", F.concat_ws("\x1f", F.lit("box"), "locator.page", "locator.y0", "locator.y1")).when(kind == "page", F.concat_ws("\x1f", F.lit("page"), "locator.page", "ordinal")).otherwise(F.raise_error(F.lit("a table part needs a cell, box or page locator")))
    said = F.when(F.size("rel") > 0, F.concat(F.array_join(F.transform("rel", lambda x: x["t"]), " / "), F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    cell = p.select("document_id", "ordinal", key.alias("row"), said.alias("said"), F.concat(F.array("part_id"), F.transform("rel", lambda x: x["target_part_id"])).alias("ids"))
    g = cell.groupBy("document_id", "row").agg(F.array_sort(F.collect_list(F.struct("ordinal", "said", "ids"))).alias("c"), F.min("ordinal").alias("o"))
    return _renumber(g.select("document_id", "o", F.array_distinct(F.flatten(F.transform("c", lambda x: x["ids"]))).alias("part_ids"), F.array_join(F.transform("c", lambda x: x["said"]), " | ").alias("text")), "o")


def scenes(parts: DataFrame) -> DataFrame:
    """Each time span with the keyframes linked to it; a keyframe has exactly one link."""
    frames = parts.where("locator.kind = 'keyframe'")
    link = F.filter("relations", lambda r: r["kind"] == "keyframe_of")
    one = F.when(F.size(link) == 1, F.get(link, F.lit(0))["target_part_id"]).otherwise(F.raise_error(F.lit("a keyframe needs exactly one scene")))
    linked = frames.select("document_id", one.alias("part_id"), "ordinal", F.col("part_id").alias("frame_id"), F.col("text").alias("frame"))
    held = linked.groupBy("document_id", "part_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "frame_id", "frame"))).alias("f"))
    own = parts.where("locator.kind <> 'keyframe'").join(held, ["document_id", "part_id"], "left")
    f = F.coalesce("f", F.array().cast("array<struct<ordinal:int,frame_id:string,frame:string>>"))
    ids = F.concat(F.array("part_id"), F.transform(f, lambda x: x["frame_id"]))
    text = F.array_join(F.concat(F.array("text"), F.transform(f, lambda x: x["frame"])), " ")
    return _renumber(own.select("document_id", F.col("ordinal").alias("o"), ids.alias("part_ids"), text.alias("text")), "o")


def prose(parts: DataFrame, policy: S.Policy) -> DataFrame:
    """A text strategy over the parts of a document, whole parts only: fixed and sliding fill
    groups, any other finds spans in the joined text and takes the parts that they touch."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                texts, ids = [p["text"] for p in ps], [p["part_id"] for p in ps]
                if policy.strategy == "fixed":
                    groups = S.fill_whole([len(t) for t in texts], policy.max_chars)
                elif policy.strategy == "sliding_window":
                    groups = S.slide_whole([len(t) for t in texts], policy.max_chars, policy.overlap_chars)
                else:
                    whole, ranges = S.joined(texts)
                    groups = S.overlapping(ranges, [(lo, hi) for lo, hi, _ in S.spans(whole, policy, doc)])
                rows += [{"document_id": doc, "ordinal": i, "part_ids": [ids[j] for j in g], "text": "\n\n".join(texts[j] for j in g)} for i, g in enumerate(groups)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("document_id", pa.string()), ("ordinal", pa.int32()), ("part_ids", pa.list_(pa.string())), ("text", pa.string())]))

    docs = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "part_id", "text"))).alias("ps"))
    return docs.mapInArrow(run, "document_id string, ordinal int, part_ids array<string>, text string")


def touched_parts(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """Interval join inside a document: (document_id, span, part) where the two overlap."""
    s, r = spans.alias("s"), ranges.alias("r")
    return s.join(r, (F.col("s.document_id") == F.col("r.document_id")) & (F.col("r.start") < F.col("s.end")) & (F.col("r.end") > F.col("s.start"))).select("s.document_id", "s.span", "r.part")


def invalid_segments(segments: DataFrame, duration_ms: str = "duration_ms") -> DataFrame:
    """Transcript segments (document_id, ordinal, start_ms, end_ms) that are empty, overlap the one
    before or run over the medium's duration."""
    before = F.lag("end_ms").over(W.partitionBy("document_id").orderBy("ordinal"))
    reason = F.when(F.col("end_ms") <= F.col("start_ms"), "empty").when(before > F.col("start_ms"), "overlap").when(F.col("end_ms") > F.col(duration_ms), "beyond the end")
    return segments.withColumn("reason", reason).where("reason IS NOT NULL")


def keyframes(scenes_: DataFrame) -> DataFrame:
    """The middle of each scene, linked to it."""
    return scenes_.select("document_id", F.concat(F.col("part_id"), F.lit("-keyframe")).alias("part_id"), F.floor((F.col("start_ms") + F.col("end_ms")) / 2).cast("long").alias("timestamp_ms"), F.array(F.struct(F.col("part_id").alias("target_part_id"), F.lit("keyframe_of").alias("kind"))).alias("relations"))


def form_links(words: DataFrame) -> DataFrame:
    """OCR words linked to the word before on their page that lies left and level with them."""
    w = W.partitionBy("document_id", "page").orderBy("ordinal")
    p = F.lag(F.struct("part_id", "x1", "y0", "y1")).over(w)
    level = (p["x1"] <= F.col("x0")) & (p["y0"] < F.col("y1")) & (p["y1"] > F.col("y0"))
    return words.withColumn("labeled_by", F.when(level, p["part_id"]))


def continues(parts: DataFrame) -> DataFrame:
    """Layout parts linked to the part before in the same container."""
    return parts.withColumn("continues", F.lag("part_id").over(W.partitionBy("document_id", "container").orderBy("ordinal")))


def mixed(ocr: DataFrame, vision: DataFrame) -> DataFrame:
    """OCR parts, then vision parts of the same asset, numbered anew."""
    both = ocr.withColumn("side", F.lit(0)).unionByName(vision.withColumn("side", F.lit(1)))
    w = W.partitionBy("document_id").orderBy("side", "ordinal")
    return both.withColumn("ordinal", F.row_number().over(w) - 1).drop("side").withColumn("content_mode", F.lit("mixed_image_text"))
