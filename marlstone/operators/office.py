"""Slides, sheets and laid-out pages as located parts, read from their archives' XML.

Parts are rows (uri, part_id, ordinal, text, locator, relations, notices): a cell or box locator,
``continues`` to the part before in the same sheet, table or page and ``labeled_by`` to the head of
the column.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta
from io import BytesIO
from xml.etree import ElementTree
from zipfile import BadZipFile, ZipFile

import pyarrow as pa
from pyspark.sql import DataFrame

from .extraction import archive_sizes_ok

PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/vnd.ms-excel.sheet.macroEnabled.12")
PDF = "application/pdf"
LOCATOR = "struct<kind:string,page:int,x0:double,y0:double,x1:double,y1:double,sheet:string,start_row:int,start_col:int,end_row:int,end_col:int>"
PARTS = f"uri string, part_id string, ordinal int, text string, locator {LOCATOR}, relations array<struct<target_part_id:string,kind:string>>, notices array<string>"
_LOCATOR = pa.struct([("kind", pa.string()), ("page", pa.int32()), *[(n, pa.float64()) for n in ("x0", "y0", "x1", "y1")], ("sheet", pa.string()), *[(n, pa.int32()) for n in ("start_row", "start_col", "end_row", "end_col")]])
_PARTS = pa.schema([("uri", pa.string()), ("part_id", pa.string()), ("ordinal", pa.int32()), ("text", pa.string()), ("locator", _LOCATOR), ("relations", pa.list_(pa.struct([("target_part_id", pa.string()), ("kind", pa.string())]))), ("notices", pa.list_(pa.string()))])


@dataclass(frozen=True)
class Limits:
    """Bounds of one file; going over one is an error."""

    slides: int = 500
    sheets: int = 100
    pages: int = 500
    cells: int = 100_000
    expanded_bytes: int = 256 << 20
    ratio: float = 200.0


def open_archive(content: bytes, limits: Limits) -> ZipFile:
    """The archive, if it is whole and what its members would expand to stays within the bounds."""
    try:
        z = ZipFile(BytesIO(content))
    except BadZipFile as e:
        raise ValueError("the archive is damaged") from e
    sizes = [(m.compress_size, m.file_size) for m in z.infolist()]
    if not archive_sizes_ok([(sum(c for c, _ in sizes), sum(e for _, e in sizes))], limits.expanded_bytes, limits.ratio):
        raise OverflowError("the archive expands too far")
    return z


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _named(node, name: str) -> Iterator:
    return (x for x in node.iter() if _local(x.tag) == name)


def _child(node, *path: str):
    for name in path:
        node = None if node is None else next((x for x in node if _local(x.tag) == name), None)
    return node


def _attribute(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None) if node is not None else None


def _xml(z: ZipFile, name: str):
    return ElementTree.fromstring(z.read(name))


def _targets(z: ZipFile, of: str) -> dict[str, tuple[str, str]]:
    """Relationship id -> (kind, member) of the part ``of``."""
    folder, name = posixpath.split(of)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in z.namelist():
        return {}
    place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
    return {r.get("Id"): (r.get("Type", "").rpartition("/")[2], place(r.get("Target", ""))) for r in _xml(z, rels)}


class _Parts:
    """Parts of one file, each linked to the one before in its container."""

    def __init__(self, uri: str):
        self.uri, self.rows, self.container = uri, [], None

    def add(self, part_id: str, text: str, locator: dict, container, label: str | None = None, notices: tuple[str, ...] = ()) -> None:
        links = [{"target_part_id": self.rows[-1]["part_id"], "kind": "continues"}] if self.rows and container == self.container else []
        links += [{"target_part_id": label, "kind": "labeled_by"}] if label else []
        self.container = container
        self.rows.append({"uri": self.uri, "part_id": part_id, "ordinal": len(self.rows), "text": text, "locator": locator, "relations": links, "notices": list(notices)})


def _box(page: int, x0: float, y0: float, x1: float, y1: float, width: float, height: float) -> dict:
    if width <= 0 or height <= 0:
        raise ValueError("a page or slide has no size")
    return {"kind": "box", "page": page, "x0": x0 / width, "y0": y0 / height, "x1": x1 / width, "y1": y1 / height}


def _cell(sheet: str, row: int, col: int, end: tuple[int, int] | None) -> dict:
    return {"kind": "cell", "sheet": sheet, "start_row": row, "start_col": col, "end_row": end and end[0], "end_col": end and end[1]}


def _paragraphs(body) -> str:
    """The text of a shape or cell: runs joined, a line for each paragraph."""
    lines = []
    for p in (x for x in (body if body is not None else ()) if _local(x.tag) == "p"):
        lines.append("".join("\v" if _local(r.tag) == "br" else "".join(t.text or "" for t in _named(r, "t")) for r in p if _local(r.tag) in ("r", "br", "fld")))
    return "\n".join(lines).strip()


def _place(shape) -> tuple[int, int, int, int]:
    """(left, top, width, height); of a placeholder without its own, zeros."""
    frame = _child(shape, "spPr", "xfrm")
    frame = frame if frame is not None else _child(shape, "xfrm")
    off, ext = _child(frame, "off"), _child(frame, "ext")
    get = lambda n, a: int(n.get(a, 0)) if n is not None else 0
    return get(off, "x"), get(off, "y"), get(ext, "cx"), get(ext, "cy")


def pptx_parts(uri: str, content: bytes, limits: Limits = Limits()) -> list[dict]:
    """Shapes from top to bottom and left to right, tables cell by cell; a picture is an error, since
    its text would be lost."""
    with open_archive(content, limits) as z:
        deck, rels = _xml(z, "ppt/presentation.xml"), _targets(z, "ppt/presentation.xml")
        size = next(_named(deck, "sldSz"))
        width, height = float(size.get("cx")), float(size.get("cy"))
        slides = [rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))][1] for s in _named(deck, "sldId")]
        if len(slides) > limits.slides:
            raise OverflowError(f"more than {limits.slides} slides")
        out, cells = _Parts(uri), 0
        for n, name in enumerate(slides):
            tree = _child(_xml(z, name), "cSld", "spTree")
            shapes = sorted((s for s in tree if _local(s.tag) in ("sp", "pic", "graphicFrame", "grpSp", "cxnSp")), key=lambda s: _place(s)[1::-1])
            for i, shape in enumerate(shapes):
                if _local(shape.tag) == "pic":
                    raise ValueError(f"slide {n} holds a picture: it belongs to vision")
                table = next(_named(shape, "tbl"), None) if _local(shape.tag) == "graphicFrame" else None
                if table is not None:
                    heads: dict[int, str] = {}
                    rows = [r for r in table if _local(r.tag) == "tr"]
                    for r, row in enumerate(rows):
                        for c, cell in enumerate(x for x in row if _local(x.tag) == "tc"):
                            text = _paragraphs(_child(cell, "txBody"))
                            if not text:
                                continue
                            cells += 1
                            if cells > limits.cells:
                                raise OverflowError(f"more than {limits.cells} cells")
                            tall, broad = int(cell.get("rowSpan", 1)), int(cell.get("gridSpan", 1))
                            part, sheet = f"pptx-s{n}-t{i}-r{r}-c{c}", f"slide:{n}:table:{i}"
                            out.add(part, text, _cell(sheet, r, c, (r + tall - 1, c + broad - 1) if tall > 1 or broad > 1 else None), ("cell", sheet), heads.get(c))
                            if r == 0:
                                heads[c] = part
                elif _local(shape.tag) == "sp" and (text := _paragraphs(_child(shape, "txBody"))):
                    x, y, w, h = _place(shape)
                    out.add(f"pptx-s{n}-shape{i}", text, _box(n, x, y, x + w, y + h, width, height), ("box", n))
    if not out.rows:
        raise ValueError("the presentation holds no text")
    return out.rows


_REF = re.compile(r"([A-Z]+)(\d+)")


def _at(ref: str) -> tuple[int, int]:
    letters, digits = _REF.fullmatch(ref.replace("$", "")).groups()
    col = 0
    for c in letters:
        col = col * 26 + ord(c) - 64
    return int(digits) - 1, col - 1


_DATES = {*range(14, 23), 45, 46, 47}


def _date_styles(z: ZipFile) -> set[int]:
    """Indices of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in z.namelist():
        return set()
    styles = _xml(z, "xl/styles.xml")
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "")) for f in _named(styles, "numFmt")}
    dated = lambda i: i in _DATES or bool(re.search(r"[dmyhs]", own.get(i, ""), re.I))
    formats = _child(styles, "cellXfs")
    return {k for k, x in enumerate(formats if formats is not None else ()) if dated(int(x.get("numFmtId", 0)))}


def _shown(cell, shared: list[str], dates: set[int]) -> str | None:
    """The value of a cell as text, None if it has none."""
    kind, v = cell.get("t", "n"), _child(cell, "v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _named(_child(cell, "is"), "t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return shared[int(v.text)]
    if kind == "b":
        return str(v.text == "1")
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    if int(cell.get("s", 0)) in dates:
        return str(datetime(1899, 12, 30) + timedelta(milliseconds=round(number * 86_400_000)))
    return str(int(v.text)) if re.fullmatch(r"-?\d+", v.text) else str(number)


def xlsx_parts(uri: str, content: bytes, limits: Limits = Limits()) -> list[dict]:
    """Populated cells row by row; a formula with the value last shown, or a notice that there is none."""
    with open_archive(content, limits) as z:
        book, rels = _xml(z, "xl/workbook.xml"), _targets(z, "xl/workbook.xml")
        sheets = [(s.get("name"), *rels[next(v for k, v in s.attrib.items() if k.endswith("}id"))]) for s in _named(book, "sheet")]
        sheets = [(name, member) for name, kind, member in sheets if kind == "worksheet"]
        if len(sheets) > limits.sheets:
            raise OverflowError(f"more than {limits.sheets} sheets")
        shared = ["".join(t.text or "" for t in _named(s, "t")) for s in _xml(z, "xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in z.namelist() else []
        dates, out, cells = _date_styles(z), _Parts(uri), 0
        for name, member in sheets:
            sheet, heads = _xml(z, member), {}
            merged = {_at(lo): _at(hi) for lo, _, hi in (m.get("ref").partition(":") for m in _named(sheet, "mergeCell")) if hi}
            for cell in _named(sheet, "c"):
                row, col = _at(cell.get("r"))
                formula, shown, notices = _child(cell, "f"), _shown(cell, shared, dates), ()
                if formula is not None:
                    text = f"={formula.text or ''}"
                    text, notices = (text, ("formula_cached_value_unavailable",)) if shown is None else (f"{text} [displayed: {shown}]", ())
                elif shown is None:
                    continue
                else:
                    text = shown
                cells += 1
                if cells > limits.cells:
                    raise OverflowError(f"more than {limits.cells} cells")
                part = f"xlsx-{name}-r{row}-c{col}"
                out.add(part, text, _cell(name, row, col, merged.get((row, col))), ("cell", name), heads.get(col), notices)
                if row == 0:
                    heads[col] = part
    if not out.rows:
        raise ValueError("the workbook holds no populated cell")
    return out.rows


#: What a reader of pages gives for each: its size, whether it holds images, and its words in reading
#: order as (text, x0, top, x1, bottom).
PageReader = Callable[[bytes], list[tuple[float, float, bool, list[tuple[str, float, float, float, float]]]]]


def pdf_parts(uri: str, content: bytes, reader: PageReader, limits: Limits = Limits()) -> list[dict]:
    """Words of the pages that ``reader`` takes apart; a page with images or without words is an error,
    since it belongs to OCR."""
    pages, out = reader(content), _Parts(uri)
    if len(pages) > limits.pages:
        raise OverflowError(f"more than {limits.pages} pages")
    for n, (width, height, images, words) in enumerate(pages):
        if images or not words:
            raise ValueError(f"page {n} " + ("holds images" if images else "has no machine-readable text") + ": it belongs to OCR")
        for text, x0, top, x1, bottom in words:
            if text.strip():
                out.add(f"pdf-p{n}-w{len(out.rows)}", text.strip(), _box(n, x0, top, x1, bottom, width, height), ("box", n), notices=("heuristic_reading_order",))
    if not out.rows:
        raise ValueError("the document holds no text")
    return out.rows


def layout_parts(assets: DataFrame, limits: Limits = Limits(), pdf_reader: PageReader | None = None) -> DataFrame:
    """Parts of binary assets (uri, media_type, content), a file at a time."""

    def parse(uri: str, kind: str, content: bytes) -> list[dict]:
        if kind == PPTX:
            return pptx_parts(uri, content, limits)
        if kind in XLSX:
            return xlsx_parts(uri, content, limits)
        if kind == PDF and pdf_reader:
            return pdf_parts(uri, content, pdf_reader, limits)
        raise ValueError(f"no layout reader takes {kind}")

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                rows = parse(*(b.column(c)[i].as_py() for c in range(3)))
                yield pa.RecordBatch.from_pylist(rows, _PARTS)

    return assets.select("uri", "media_type", "content").mapInArrow(run, PARTS)
