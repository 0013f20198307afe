"""Classification of assets and extraction of exact text spans."""

from __future__ import annotations

import re
from email import policy as mail_policy
from email.parser import BytesParser
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed_span
from ..sources.files import TEXT_KINDS

#: Media types that each declared family takes.
ALLOWED = {
    "ocr": ("application/pdf", "image/bmp", "image/jpeg", "image/png", "image/tiff", "image/webp"),
    "layout": ("application/pdf", "application/vnd.ms-excel.sheet.macroEnabled.12", "application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    "vision": ("image/bmp", "image/jpeg", "image/png", "image/tiff", "image/webp"),
    "media": ("audio/flac", "audio/mp4", "audio/mpeg", "audio/wav", "video/mp4", "video/webm"),
    "text": tuple(sorted(TEXT_KINDS)),
}


def classify(assets: DataFrame, family: str = "text") -> DataFrame:
    """Assets with ``family`` and ``confidence`` 1; a media type that the family doesn't take is an
    error when the row is read."""
    if family not in ALLOWED:
        raise ValueError(f"{family!r} is no content family")
    ok = F.col("media_type").isin(*ALLOWED[family])
    fail = F.raise_error(F.concat(F.lit(f"{family} takes no "), F.col("media_type")))
    return assets.withColumn("family", F.when(ok, F.lit(family)).otherwise(fail)).withColumn("confidence", F.lit(1.0))


class _Visible(HTMLParser):
    """Source spans of text nodes and of single references; script and style are passed over."""

    HIDDEN = ("script", "style")

    def __init__(self, source: str, strict: bool = True):
        super().__init__(convert_charrefs=False)
        self.source, self.hidden, self.found, self.strict = source, 0, [], strict
        self.lines = [0]
        for line in source.splitlines(keepends=True):
            self.lines.append(self.lines[-1] + len(line))

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in self.HIDDEN

    def handle_endtag(self, tag):
        self.hidden -= tag in self.HIDDEN and self.hidden > 0

    def _take(self, said: str) -> None:
        if self.hidden:
            return
        row, col = self.getpos()
        at = self.lines[row - 1] + col
        if not self.strict and said[-1:] == ";" and not self.source.startswith(said, at):
            said = said[:-1]  # a reference without its semicolon, as it stands in the source
        if not self.source.startswith(said, at):
            raise ValueError("a parsed piece of HTML isn't where the source has it")
        body = said.strip()
        if body:
            at += len(said) - len(said.lstrip())
            self.found.append((at, at + len(body)))

    def handle_data(self, data):
        self._take(data)

    def handle_entityref(self, name):
        self._take(f"&{name};")

    def handle_charref(self, name):
        self._take(f"&#{name};")


def html_spans(source: str, strict: bool = True) -> list[tuple[int, int]]:
    """Spans of the visible pieces; a reference that lacks its semicolon is an error if ``strict``,
    otherwise a piece as written."""
    p = _Visible(source, strict)
    p.feed(source)
    p.close()
    return p.found


_HEAD_END = re.compile(r"(?:\r?\n){2}")


def email_span(source: str) -> list[tuple[int, int]]:
    """The body of a single-part message without transfer encoding."""
    m = BytesParser(policy=mail_policy.default).parsebytes(source.encode())
    if m.is_multipart():
        raise ValueError("a multipart message has no single exact body")
    if (m.get("Content-Transfer-Encoding") or "7bit").casefold() not in ("7bit", "8bit", "binary"):
        raise ValueError("an encoded body has no exact span")
    end = _HEAD_END.search(source)
    if not end:
        raise ValueError("a message needs a blank line after its head")
    body = source[end.end() :]
    s = body.strip()
    at = end.end() + len(body) - len(body.lstrip())
    return [(at, at + len(s))] if s else []


def _spans_by_parser(docs: DataFrame, id_column: str, text: str, parse) -> DataFrame:
    def run(batches):
        for b in batches:
            rows = [(i, n, s, e, t[s:e]) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for n, (s, e) in enumerate(parse(t))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *[pa.array(c, pa.int32()) for c in cols[1:4]], pa.array(cols[4], pa.string())], names=["id", "ordinal", "start", "end", "text"])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(run, f"id {kind}, ordinal int, start int, end int, text string").withColumnRenamed("id", id_column)


def html_text(pages: DataFrame, id_column: str = "page_id", text: str = "html", strict: bool = True) -> DataFrame:
    """(id, ordinal, start, end, text): the visible pieces of each page at their exact place."""
    return _spans_by_parser(pages, id_column, text, lambda t: html_spans(t, strict))


def email_text(messages: DataFrame, id_column: str, text: str) -> DataFrame:
    return _spans_by_parser(messages, id_column, text, email_span)


def whole_span(text: Column) -> Column:
    """Plain text, markdown and code: the one span without outer white space."""
    return trimmed_span(text, F.lit(0))


def extract_text(assets: DataFrame) -> DataFrame:
    """Parts (uri, part_id, ordinal, start, end, text, text_kind) of binary text assets (uri,
    media_type, content): strict UTF-8, one document each."""
    kinds = F.create_map(*[F.lit(x) for kv in sorted(TEXT_KINDS.items()) for x in kv])
    a = assets.select("uri", "media_type", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "uri"))).alias("text"))
    a = a.withColumn("text_kind", F.coalesce(F.try_element_at(kinds, F.col("media_type")), F.raise_error(F.concat(F.lit("no text: "), "media_type"))))

    def parse(batches):
        for b in batches:
            rows = []
            for uri, kind, text in zip(*(c.to_pylist() for c in b.columns)):
                found = html_spans(text) if kind == "html" else email_span(text) if kind == "email" else [(len(text) - len(text.lstrip()), len(text.rstrip()))] if text.strip() else []
                rows += [{"uri": uri, "part_id": f"text-{i}", "ordinal": i, "start": s, "end": e, "text": text[s:e], "text_kind": kind} for i, (s, e) in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("uri", pa.string()), ("part_id", pa.string()), *[(n, pa.int32()) for n in ("ordinal", "start", "end")], ("text", pa.string()), ("text_kind", pa.string())]))

    return a.select("uri", "text_kind", "text").mapInArrow(parse, "uri string, part_id string, ordinal int, start int, end int, text string, text_kind string")


def too_many_parts(parts: DataFrame, most: int, key: str = "document_id") -> DataFrame:
    """Documents over the part limit; must be empty."""
    return parts.groupBy(key).count().where(F.col("count") > most)


def archive_sizes_ok(sizes: list[tuple[int, int]], most_bytes: int, most_ratio: float) -> bool:
    """Whether an archive's members (compressed, expanded) stay within both bounds."""
    return sum(e for _, e in sizes) <= most_bytes and all(e <= most_ratio * max(c, 1) for c, e in sizes)
