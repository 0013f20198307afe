"""Slides, sheets, pages, OCR words, model descriptions and transcripts as parts."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from marlstone.operators import modality as M
from marlstone.operators import office as O
from marlstone.operators import recognition as G


def archive(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("DOT", "."), body)
    return out.getvalue()


A, P, R = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{}</Relationships>'


def _shape(text, x, y):
    runs = "".join(f"<a:p><a:r><a:t>{line}</a:t></a:r></a:p>" for line in text.split("\n"))
    return f'<p:sp><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/><a:ext cx="100" cy="50"/></a:xfrm></p:spPr><p:txBody>{runs}</p:txBody></p:sp>'


def _deck(*shapes):
    slide = f'<p:sld xmlns:a="{A}" xmlns:p="{P}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'
    deck = f'<p:presentation xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId id="256" r:id="rId1"/></p:sldIdLst><p:sldSz cx="1000" cy="500"/></p:presentation>'
    rel = RELS.format(f'<Relationship Id="rId1" Type="{R}/slide" Target="slides/slide1.xml"/>')
    return archive(**{"ppt__presentationDOTxml": deck, "ppt___rels__presentationDOTxmlDOTrels": rel, "ppt__slides__slide1DOTxml": slide})


def test_slides():
    cell = lambda t, extra="": f"<a:tc{extra}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f'<p:graphicFrame><p:xfrm><a:off x="0" y="300"/><a:ext cx="9" cy="9"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr>{cell("Item")}{cell("Cost")}</a:tr><a:tr>{cell("Pump", " rowSpan=" + chr(34) + "2" + chr(34))}{cell("12")}</a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
    got = O.pptx_parts("u", _deck(table, _shape("right", 500, 10), _shape("left\nsecond", 100, 10), _shape(" ", 0, 0)))
    assert [(p["part_id"], p["text"]) for p in got] == [("pptx-s0-shape1", "left\nsecond"), ("pptx-s0-shape2", "right"), ("pptx-s0-t3-r0-c0", "Item"), ("pptx-s0-t3-r0-c1", "Cost"), ("pptx-s0-t3-r1-c0", "Pump"), ("pptx-s0-t3-r1-c1", "12")]
    assert got[0]["locator"] == {"kind": "box", "page": 0, "x0": 0.1, "y0": 0.02, "x1": 0.2, "y1": 0.12}
    assert got[1]["relations"] == [{"target_part_id": "pptx-s0-shape1", "kind": "continues"}]
    assert got[2]["relations"] == [] and got[5]["relations"] == [{"target_part_id": "pptx-s0-t3-r1-c0", "kind": "continues"}, {"target_part_id": "pptx-s0-t3-r0-c1", "kind": "labeled_by"}]
    assert (got[4]["locator"]["end_row"], got[4]["locator"]["end_col"]) == (2, 0)
    with pytest.raises(ValueError, match="picture"):
        O.pptx_parts("u", _deck(f'<p:pic xmlns:a="{A}"/>'))
    with pytest.raises(ValueError, match="no text"):
        O.pptx_parts("u", _deck())
    with pytest.raises(OverflowError):
        O.pptx_parts("u", _deck(table), O.Limits(cells=3))


def _workbook():
    book = f'<workbook xmlns:r="{R}"><sheets><sheet name="Plan" sheetId="1" r:id="rId7"/></sheets></workbook>'
    rel = RELS.format(f'<Relationship Id="rId7" Type="{R}/worksheet" Target="/xl/worksheets/s.xml"/>')
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Due</t></is></c></row><row r="2"><c r="A2"><v>42</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2"><f>A2*2</f><v>84</v></c><c r="D2"><f>A2/0</f></c><c r="E2" t="b"><v>1</v></c><c r="F2"/></row>'
    return {"xl__workbookDOTxml": book, "xl___rels__workbookDOTxmlDOTrels": rel, "xl__worksheets__sDOTxml": f'<worksheet><sheetData>{rows}</sheetData><mergeCells><mergeCell ref="A1:A3"/></mergeCells></worksheet>', "xl__sharedStringsDOTxml": "<sst><si><r><t>To</t></r><r><t>tal</t></r></si></sst>", "xl__stylesDOTxml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>'}


def test_sheets(spark):
    got = O.xlsx_parts("u", archive(**_workbook()))
    assert [p["text"] for p in got] == ["Total", "Due", "42", "2024-01-01 12:00:00", "=A2*2 [displayed: 84]", "=A2/0", "True"]
    assert got[0]["locator"] == {"kind": "cell", "sheet": "Plan", "start_row": 0, "start_col": 0, "end_row": 2, "end_col": 0}
    assert got[2]["relations"] == [{"target_part_id": "xlsx-Plan-r0-c1", "kind": "continues"}, {"target_part_id": "xlsx-Plan-r0-c0", "kind": "labeled_by"}]
    assert got[5]["notices"] == ["formula_cached_value_unavailable"] and got[4]["notices"] == []
    assets = spark.createDataFrame([("a", O.XLSX[0], bytearray(archive(**_workbook())))], "uri string, media_type string, content binary")
    parts = O.layout_parts(assets)
    rows = M.table_rows(parts.withColumnRenamed("uri", "document_id")).orderBy("ordinal").collect()
    assert rows[-1].text == "Total: 42 | Due: 2024-01-01 12:00:00 | =A2*2 [displayed: 84] | =A2/0 | True"
    with pytest.raises(ValueError, match="damaged"):
        O.xlsx_parts("u", b"PK no")
    bomb = archive(**{**_workbook(), "x": "0" * 10_000_000})
    with pytest.raises(OverflowError):
        O.xlsx_parts("u", bomb)
    with pytest.raises(OverflowError):
        O.xlsx_parts("u", archive(**_workbook()), O.Limits(expanded_bytes=10))


def test_pages():
    pages = [(200.0, 100.0, False, [("One", 0, 0, 20, 10), (" ", 0, 0, 1, 1), ("two", 30, 0, 50, 10)])]
    got = O.pdf_parts("u", b"", lambda c: pages)
    assert [(p["part_id"], p["text"], p["locator"]["x1"]) for p in got] == [("pdf-p0-w0", "One", 0.1), ("pdf-p0-w1", "two", 0.25)]
    for bad in ([(1.0, 1.0, True, [("x", 0, 0, 1, 1)])], [(1.0, 1.0, False, [])], [(0.0, 1.0, False, [("x", 0, 0, 1, 1)])], []):
        with pytest.raises(ValueError):
            O.pdf_parts("u", b"", lambda c, bad=bad: bad)


WORDS = "document_id string, page int, word int, text string, left int, top int, width int, height int, conf double, page_width int, page_height int"


def test_ocr_words(spark):
    words = spark.createDataFrame([("d", 0, 0, "Name", 10, 10, 40, 10, 95.0, 200, 100), ("d", 0, 1, " ", 0, 0, 1, 1, 90.0, 200, 100), ("d", 0, 2, "Ada", 60, 12, 30, 10, 50.0, 200, 100), ("d", 0, 3, "low", 0, 0, 9, 9, -1.0, 200, 100), ("d", 1, 0, "next", 100, 10, 20, 10, 80.0, 200, 100)], WORDS)
    got = G.ocr_parts(words, "form").orderBy("ordinal").collect()
    assert [(r.part_id, r.text, r.confidence) for r in got] == [("ocr-p0-w0", "Name", 0.95), ("ocr-p0-w1", "Ada", 0.5), ("ocr-p1-w0", "next", 0.8)]
    assert [[x.target_part_id for x in r.relations] for r in got] == [[], ["ocr-p0-w0"], []]
    assert got[1].notices == ["low_ocr_confidence", "form_structure_unverified"] and got[0].locator.x1 == 0.25
    assert G.ocr_parts(words).where("size(notices) > 0").count() == 1
    pages = spark.createDataFrame([("d", 0), ("d", 1), ("d", 2)], "document_id string, page int")
    assert [tuple(r) for r in G.pages_without_text(pages, G.ocr_parts(words)).collect()] == [("d", 2)]
    with pytest.raises(Exception, match="outside its page"):
        G.ocr_parts(words.withColumn("left", F.lit(190))).collect()


def test_model_descriptions_and_media(spark):
    images = spark.createDataFrame([("a", "image/png", 100, 50), ("b", "image/tiff", 1, 1), ("c", "image/png", 5000, 1)], "document_id string, media_type string, width int, height int")
    assert {tuple(r) for r in G.image_problems(images).collect()} == {("b", "media type"), ("c", "too large")}
    said = spark.createDataFrame([("a", 0, "a valve", 0.0, 0.0, 1.0, 1.0)], "document_id string, region int, text string, x0 double, y0 double, x1 double, y1 double")
    got = G.vision_parts(images.where("document_id = 'a'"), said).first()
    assert got.part_id == "vision-0" and tuple(got.notices) == G.VISION_NOTICES
    with pytest.raises(Exception, match="without description"):
        G.vision_parts(images, said).collect()
    media = spark.createDataFrame([("a", False, 5000, 5900, None), ("b", True, 5000, 5000, None), ("c", False, 5000, 6001, None), ("d", True, 5000, 5000, 9000), ("e", False, 5000, 0, None)], "document_id string, is_video boolean, probed_ms long, heard_ms long, scene_ms long")
    assert {r.document_id for r in G.media_problems(media).collect()} == {"b", "c", "d", "e"}
    length = media.where("document_id = 'a'").select("document_id", "probed_ms")
    seg = "document_id string, n int, start_s double, end_s double, text string, language string"
    parts = G.transcript_parts(spark.createDataFrame([("a", 0, 0.0, 1.2, "hi", "en"), ("a", 1, 1.2, 3.0, "there", None)], seg), length).orderBy("ordinal").collect()
    assert [(r.part_id, r.locator.start_ms, r.locator.end_ms, len(r.notices)) for r in parts] == [("transcript-0", 0, 1200, 2), ("transcript-1", 1200, 3000, 3)]
    for bad in ([("a", 0, 0.0, 2.0, "x", None), ("a", 1, 1.0, 3.0, "y", None)], [("a", 0, 0.0, 9.0, "x", None)], [("a", 0, 0.0, 1.0, " ", None)], [("a", 0, float("nan"), 1.0, "x", None)]):
        with pytest.raises(Exception, match="segment"):
            G.transcript_parts(spark.createDataFrame(bad, seg), length).collect()
    scenes = spark.createDataFrame([("a", 0, 0, 2000, 1000)], "document_id string, n int, start_ms int, end_ms int, keyframe_ms int")
    both = G.scene_parts(scenes, length).orderBy("ordinal").collect()
    assert [r.part_id for r in both] == ["scene-0", "keyframe-0"] and both[1].relations[0].target_part_id == "scene-0"
    with pytest.raises(Exception, match="keyframe"):
        G.scene_parts(scenes.withColumn("keyframe_ms", F.lit(2000)), length).collect()


def test_engines_have_deadlines(spark):
    import time

    assets = spark.createDataFrame([("u", "image/png", bytearray(b"abc"))], "uri string, media_type string, content binary")
    got = G.recognised(assets, lambda content, kind: [{"text": kind, "n": len(content)}], "text string, n int").collect()
    assert [tuple(r) for r in got] == [("u", "image/png", 3)]
    with pytest.raises(Exception, match="took more than"):
        G.recognised(assets, lambda content, kind: time.sleep(5), "text string", seconds=0.2).collect()
    with pytest.raises(G.DeadlineExceeded):
        with G.deadline(0.05, "nap"):
            time.sleep(1)
