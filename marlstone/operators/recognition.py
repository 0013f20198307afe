"""What OCR, vision, speech and scene engines return, checked and made into located parts.

The engines themselves are functions that are passed in (see :func:`recognised`); everything that is
done with their results is here, over tables.
"""

from __future__ import annotations

import signal
import threading
from collections.abc import Callable
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class DeadlineExceeded(TimeoutError):
    pass


@contextmanager
def deadline(seconds: float, label: str):
    """An error if the block takes longer; only where a timer can interrupt it, i.e. on a main thread."""
    if threading.current_thread() is not threading.main_thread() or not hasattr(signal, "setitimer"):
        raise RuntimeError("a deadline needs the main thread of a POSIX process")

    def late(number, frame):
        raise DeadlineExceeded(f"{label} took more than {seconds:g} s")

    handler, timer = signal.signal(signal.SIGALRM, late), signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, *timer)
        signal.signal(signal.SIGALRM, handler)


def recognised(assets: DataFrame, engine: Callable[[bytes, str], list[dict]], schema: str, seconds: float = 60.0) -> DataFrame:
    """(uri, *schema): the rows that ``engine(content, media_type)`` gives for each asset, each call in a
    Python worker and under a deadline."""
    fields = assets.sparkSession.createDataFrame([], f"uri string, {schema}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(fields)
        for b in batches:
            for i in range(b.num_rows):
                uri, kind, content = (b.column(c)[i].as_py() for c in range(3))
                with deadline(seconds, f"recognition of {uri}"):
                    rows = engine(content, kind)
                yield pa.RecordBatch.from_pylist([{"uri": uri, **r} for r in rows], arrow)

    return assets.select("uri", "media_type", "content").mapInArrow(run, fields)


def _check(value: Column, *rules: tuple[Column, str]) -> Column:
    """The value, or the error of the first rule that is broken."""
    out = value
    for broken, message in reversed(rules):
        out = F.when(broken, F.raise_error(F.lit(message))).otherwise(out)
    return out


def _numbered(df: DataFrame, *order: str) -> DataFrame:
    return df.withColumn("ordinal", F.row_number().over(W.partitionBy("document_id").orderBy(*order)) - 1)


def ocr_parts(words: DataFrame, mode: str = "printed", least_confidence: float = 0.6) -> DataFrame:
    """(document_id, ordinal, part_id, text, locator, confidence, relations, notices) of the words of an
    engine (document_id, page, word, text, left, top, width, height, conf, page_width, page_height).

    Blank words and those of negative confidence are dropped; boxes become shares of the page.  In
    ``form`` mode a word is labelled by the word before it, if that lies left of and level with it
    on the same page.
    """
    if mode not in ("printed", "handwriting", "form") or not 0 <= least_confidence <= 1:
        raise ValueError("mode is printed, handwriting or form, and the threshold lies in [0, 1]")
    w = words.where((F.trim("text") != "") & (F.col("conf") >= 0))
    right, bottom = F.col("left") + F.col("width"), F.col("top") + F.col("height")
    text = _check(F.trim("text"), (F.col("conf") > 100, "confidence goes to 100"), ((F.least("left", "top") < 0) | (F.least("width", "height") <= 0), "a box has a size and no negative place"), ((right > F.col("page_width")) | (bottom > F.col("page_height")), "a box lies outside its page"))
    w = w.withColumn("text", text).withColumns({"x0": F.col("left") / F.col("page_width"), "y0": F.col("top") / F.col("page_height"), "x1": right / F.col("page_width"), "y1": bottom / F.col("page_height")})
    w = w.withColumn("n", F.row_number().over(W.partitionBy("document_id", "page").orderBy("word")) - 1)
    w = _numbered(w.withColumn("part_id", F.concat(F.lit("ocr-p"), F.col("page").cast("string"), F.lit("-w"), F.col("n").cast("string"))), "page", "n")
    link = F.lit(None).cast("string")
    if mode == "form":
        p = F.lag(F.struct("part_id", "x1", "y0", "y1")).over(W.partitionBy("document_id", "page").orderBy("n"))
        link = F.when((p["x1"] <= F.col("x0")) & (p["y0"] < F.col("y1")) & (p["y1"] > F.col("y0")), p["part_id"])
    confidence = F.col("conf") / 100.0
    said = {"handwriting": "handwriting_best_effort", "form": "form_structure_unverified"}.get(mode)
    notices = F.filter(F.array(F.when(confidence < least_confidence, F.lit("low_ocr_confidence")), F.lit(said).cast("string")), lambda x: x.isNotNull())
    relations = F.filter(F.array(F.when(link.isNotNull(), F.struct(link.alias("target_part_id"), F.lit("labeled_by").alias("kind")))), lambda x: x.isNotNull())
    return w.select("document_id", "ordinal", "part_id", "text", F.struct(F.lit("box").alias("kind"), "page", "x0", "y0", "x1", "y1").alias("locator"), confidence.alias("confidence"), relations.alias("relations"), notices.alias("notices"))


def pages_without_text(pages: DataFrame, parts: DataFrame) -> DataFrame:
    """(document_id, page) of pages of which OCR gave nothing, so that the document is incomplete."""
    return pages.join(parts.select("document_id", F.col("locator.page").alias("page")).distinct(), ["document_id", "page"], "left_anti")


VISION_NOTICES = ("model_derived", "confidence_unavailable", "untrusted_description")


def image_problems(images: DataFrame, most_side: int = 2048, most_pixels: int = 4_194_304) -> DataFrame:
    """(document_id, reason) of images (document_id, media_type, width, height) that no model is given."""
    reason = F.when(~F.col("media_type").isin("image/png", "image/jpeg", "image/webp"), "media type").when((F.greatest("width", "height") > most_side) | (F.col("width").cast("long") * F.col("height") > most_pixels), "too large")
    return images.select("document_id", reason.alias("reason")).where("reason IS NOT NULL")


def vision_parts(images: DataFrame, said: DataFrame, most_regions: int = 20) -> DataFrame:
    """Parts of a model's descriptions (document_id, region, text, x0, y0, x1, y1) of ``images``.

    A description has no confidence and is marked as a lead, not as evidence.  An image without any,
    a blank one and too many are errors.
    """
    n = said.groupBy("document_id").agg(F.count("*").alias("n"))
    s = images.select("document_id").join(n, "document_id", "left").join(said, "document_id", "left")
    text = _check(F.col("text"), (F.col("n").isNull(), "an image without description"), (F.col("n") > most_regions, f"more than {most_regions} regions"), (F.coalesce(F.trim("text"), F.lit("")) == "", "a blank description"))
    s = _numbered(s.withColumn("text", text), "region")
    return s.select("document_id", "ordinal", F.concat(F.lit("vision-"), F.col("ordinal").cast("string")).alias("part_id"), "text", F.struct(F.lit("box").alias("kind"), F.lit(0).alias("page"), "x0", "y0", "x1", "y1").alias("locator"), F.array(*map(F.lit, VISION_NOTICES)).alias("notices"))


#: Largest difference, in milliseconds, between a container's duration and an engine's.
DURATION_SLACK_MS = 1000


def media_problems(media: DataFrame, most_ms: int = 3_600_000) -> DataFrame:
    """(document_id, reason) of media (document_id, is_video, probed_ms, heard_ms, scene_ms): durations
    out of bounds or in disagreement, and videos without scenes."""
    apart = lambda c: F.abs(F.col(c) - F.col("probed_ms")) > DURATION_SLACK_MS
    reason = F.when(F.col("is_video") & F.col("scene_ms").isNull(), "a video without scenes").when((F.col("probed_ms") > most_ms) | (F.col("heard_ms") <= 0) | (F.col("heard_ms") > most_ms), "duration out of bounds").when(apart("heard_ms"), "transcript and container disagree").when(apart("scene_ms"), "scenes and container disagree")
    return media.select("document_id", reason.alias("reason")).where("reason IS NOT NULL")


def transcript_parts(segments: DataFrame, durations: DataFrame, most: int = 10_000) -> DataFrame:
    """Parts of a transcript (document_id, n, start_s, end_s, text, language) within ``durations``
    (document_id, probed_ms): finite, in order, apart, within the medium and not blank, or an error."""
    ms = lambda c: F.bround(F.col(c) * 1000).try_cast("long")
    order = W.partitionBy("document_id").orderBy("n")
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    s = segments.join(durations.select("document_id", "probed_ms"), "document_id").withColumns({"start_ms": ms("start_s"), "end_ms": ms("end_s"), "ordinal": F.row_number().over(order) - 1})
    s = s.withColumn("before", F.coalesce(F.lag("end_ms").over(order), F.lit(0)))
    text = _check(F.col("text"), (F.col("ordinal") >= most, f"more than {most} segments"), (bad("start_s") | bad("end_s"), "a segment isn't finite"), (F.col("start_ms") < F.col("before"), "segments overlap or aren't in order"), ((F.col("start_ms") < 0) | (F.col("end_ms") > F.col("probed_ms")), "a segment lies outside the medium"), (F.coalesce(F.trim("text"), F.lit("")) == "", "a blank segment"))
    notices = F.filter(F.array(F.lit("speaker_unknown"), F.lit("asr_signal_unavailable"), F.when(F.col("language").isNull(), "language_unknown")), lambda x: x.isNotNull())
    return s.select("document_id", "ordinal", F.concat(F.lit("transcript-"), F.col("ordinal").cast("string")).alias("part_id"), text.alias("text"), F.struct(F.lit("time").alias("kind"), "start_ms", "end_ms").alias("locator"), notices.alias("notices"))


def scene_parts(scenes: DataFrame, durations: DataFrame, most: int = 1000) -> DataFrame:
    """A part for each scene (document_id, n, start_ms, end_ms, keyframe_ms) and one for its keyframe,
    linked to it; scenes in order, apart and within the medium, keyframes within their scene."""
    order = W.partitionBy("document_id").orderBy("n")
    s = scenes.join(durations.select("document_id", "probed_ms"), "document_id").withColumn("i", F.row_number().over(order) - 1).withColumn("before", F.coalesce(F.lag("end_ms").over(order), F.lit(0)))
    i = F.col("i").cast("string")
    start = _check(F.col("start_ms"), (F.col("i") >= most, f"more than {most} scenes"), ((F.col("start_ms") < F.col("before")) | (F.col("end_ms") > F.col("probed_ms")), "scenes overlap or leave the medium"), ((F.col("keyframe_ms") < F.col("start_ms")) | (F.col("keyframe_ms") >= F.col("end_ms")), "a keyframe lies outside its scene"))
    links = "array<struct<target_part_id:string,kind:string>>"
    scene = F.struct((F.col("i") * 2).alias("ordinal"), F.concat(F.lit("scene-"), i).alias("part_id"), F.lit("[scene]").alias("text"), F.struct(F.lit("time").alias("kind"), start.alias("start_ms"), "end_ms").alias("locator"), F.array().cast(links).alias("relations"), F.array(F.lit("scene_derived")).alias("notices"))
    frame = F.struct((F.col("i") * 2 + 1).alias("ordinal"), F.concat(F.lit("keyframe-"), i).alias("part_id"), F.lit("[keyframe]").alias("text"), F.struct(F.lit("keyframe").alias("kind"), F.col("keyframe_ms").alias("start_ms"), F.col("keyframe_ms").alias("end_ms")).alias("locator"), F.array(F.struct(F.concat(F.lit("scene-"), i).alias("target_part_id"), F.lit("keyframe_of").alias("kind"))).alias("relations"), F.array(F.lit("keyframe_derived")).alias("notices"))
    return s.select("document_id", F.explode(F.array(scene, frame)).alias("p")).select("document_id", "p.*")
