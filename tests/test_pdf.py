"""The PDF reader, filters, drawing and sinks on files made here."""

import base64
import os
import random
import re
import zlib

import numpy as np
import pytest

from quire.sources import filters as Z
from quire.sources import pdf_tables as T
from quire.sources.fixtures import build_pdf
from quire.sources.pdf import Document, Lexer, Name, PdfError, Ref, content_ops
from quire.sources.raster_page import draw, fill_mask, luma
from quire.sources.sinks import encode_gray, encode_page, rgb_rows, write_pages


def read(data: bytes):
    return Lexer(data).read()


def test_objects():
    assert read(b"<< /A#20B [1 -2.5 (a\\(b\\)\\101) <414> true null 3 0 R] >>") == {"A B": [1, -2.5, b"a(b)A", b"A@", True, None, Ref(3, 0)]}
    assert read(b"% remark\n/Name") == Name("Name")
    assert read(b"(nested (parens) \\\n kept)") == b"nested (parens)  kept"


def test_filters_round_trip():
    data = bytes(range(256)) * 5 + b"\0\0\0\0" * 3
    assert Z.flate(zlib.compress(data)) == data
    assert Z.ascii85(base64.a85encode(data) + b"~>") == data
    assert Z.ascii_hex(data.hex().encode() + b">") == data
    assert Z.run_length(bytes([2]) + b"abc" + bytes([254]) + b"z" + bytes([128])) == b"abczzz"
    assert Z.lzw(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) == bytes([45, 45, 45, 45, 45, 65, 45, 45, 45, 66])
    cut = zlib.compress(os.urandom(5000))[:3000]
    assert len(Z.flate(cut)) > 1000


@pytest.mark.parametrize("kind", range(5))
def test_png_predictors(kind):
    rng = np.random.default_rng(kind)
    rows = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    out = bytearray()
    for y in range(6):
        out.append(kind)
        for x in range(9):
            a = int(rows[y, x - 3]) if x >= 3 else 0
            b = int(rows[y - 1, x]) if y else 0
            c = int(rows[y - 1, x - 3]) if y and x >= 3 else 0
            guess = (0, a, b, (a + b) // 2, Z.paeth(a, b, c))[kind]
            out.append((int(rows[y, x]) - guess) & 255)
    assert Z.predicted(bytes(out), 15, colors=3, columns=3) == rows.tobytes()


def test_pages_and_geometry():
    doc = Document(build_pdf([b"q Q", b""], 300, 400, page_extra=b"/CropBox [10 20 110 500] /Rotate 90 /UserUnit 2 "))
    assert len(doc.pages()) == 2
    g = doc.geometry(doc.pages()[0][2])
    assert (g["width_pts"], g["height_pts"], g["rotate_cw"], g["origin_x"], g["origin_y"]) == (760, 200, 90, 10, 20)


def test_broken_xref_is_rebuilt():
    data = build_pdf([b"0 g 1 1 4 4 re f"])
    broken = re.sub(rb"startxref\n\d+", b"startxref\n99999", data)
    assert len(Document(broken).pages()) == 1


def test_object_streams_and_xref_streams():
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 50 60] >>", b"<< /Type /Page /Parent 2 0 R >>"]
    head, body = b"", b""
    for i, o in enumerate(inner, 1):
        head += b"%d %d " % (i, len(body))
        body += o + b" "
    packed = zlib.compress(head + body)
    out = bytearray(b"%PDF-1.5\n")
    at4 = len(out)
    out += b"4 0 obj << /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >> stream\n" % (len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at5 = len(out)
    rows = b"".join(bytes([2]) + (4).to_bytes(4, "big") + bytes([i]) for i in range(3)) + bytes([1]) + at4.to_bytes(4, "big") + b"\0" + bytes([1]) + at5.to_bytes(4, "big") + b"\0"
    out += b"5 0 obj << /Type /XRef /W [1 4 1] /Index [1 5] /Size 6 /Root 1 0 R /Length %d >> stream\n" % len(rows) + rows + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at5
    doc = Document(bytes(out))
    assert doc.geometry(doc.pages()[0][2])["height_pts"] == 60


def test_errors_are_named():
    for data, kind in ((b"", "EmptyFile"), (b"hello", "NotAPdf")):
        with pytest.raises(PdfError) as e:
            Document(data)
        assert e.value.kind == kind


def test_mutated_files_never_crash(spark):
    rng, data, rows = random.Random(4), build_pdf([b"q 1 0 0 1 5 5 cm 0 0 10 10 re f Q BT (x) Tj ET"]), []
    for i in range(60):
        b = bytearray(data)
        for _ in range(rng.randint(1, 12)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        rows.append((i, bytes(b[: rng.randint(1, len(b))])))
    out = T.render(spark.createDataFrame([*rows, (98, None), (99, b"")], "doc_id long, content binary"), 72.0).collect()
    assert {r["doc_id"] for r in out} >= {98, 99}
    assert all(r["error_kind"] or len(r["pixels"]) == r["width"] * r["height"] for r in out)


def test_rectangle_rule():
    mask = fill_mask([[(1, 1), (5, 1), (5, 5), (1, 5)]], 8, 8, False)
    ys, xs = np.nonzero(mask)
    assert (ys.min(), ys.max(), xs.min(), xs.max(), mask.sum()) == (2, 4, 1, 5, 15)


def test_even_odd_leaves_holes():
    outer, inner = [(0, 0), (20, 0), (20, 20), (0, 20)], [(5, 5), (15, 5), (15, 15), (5, 15)]
    assert fill_mask([outer, inner], 30, 30, False)[10, 10]
    assert not fill_mask([outer, inner], 30, 30, True)[10, 10]


def test_drawing_order_clip_and_image():
    content = b"q 0 0 50 100 re W n 1 0 0 rg 0 0 100 100 re f Q q 20 0 0 20 60 60 cm BI /W 2 /H 1 /BPC 8 /CS /G ID \x00\xff EI Q BT (t) Tj ET zz"
    doc = Document(build_pdf([content], 100, 100))
    num, page, own = doc.pages()[0]
    p = draw(doc, page, own, doc.geometry(own), 72)
    assert tuple(p.pixels[50, 20]) == (255, 0, 0) and tuple(p.pixels[50, 70]) == (255, 255, 255)
    assert tuple(p.pixels[30, 62]) == (0, 0, 0) and tuple(p.pixels[30, 78]) == (255, 255, 255)
    assert p.seen.has_images and p.seen.has_vector_text and p.unknown == {"zz"}
    assert luma(p.pixels)[50, 20] == (2126 * 255 + 5000) // 10000


def test_inline_image_and_ops():
    ops = list(content_ops(b"/F1 12 Tf [(a) -20 (b)] TJ BI /W 1 /H 1 ID x EI f*"))
    assert [o.keyword for o in ops] == ["Tf", "TJ", "BI", "f*"]
    assert ops[2].operands[0] == {"Width": 1, "Height": 1}


def test_sinks(spark, tmp_path):
    pixels = bytes([0, 255, 127, 128, 0, 255])
    assert encode_gray(pixels, 3, 2, "pgm") == b"P5\n3 2\n255\n" + pixels
    assert encode_gray(pixels, 3, 2, "pbm") == b"P4\n3 2\n" + bytes([0b10100000, 0b01000000])
    png = encode_gray(pixels, 3, 2, "png")
    at = png.index(b"IDAT") + 4
    assert Z.predicted(zlib.decompress(png[at:-16]), 15, columns=3) == pixels
    rgb = bytes(range(18))
    assert encode_page(rgb, 3, 2, 3, "ppm") == b"P6\n3 2\n255\n" + rgb
    color = encode_page(rgb, 3, 2, 3, "png", bytes(6))
    assert color[25] == 6 and Z.predicted(zlib.decompress(color[color.index(b"IDAT") + 4 : -16]), 15, colors=4, columns=3)[:4] == bytes([0, 1, 2, 0])
    assert rgb_rows(bytes([1, 2, 3]), 1, 1, "Bgr8").tolist() == [[3, 2, 1]] and rgb_rows(bytes([0, 1, 2, 3]), 1, 1, "Xbgr8").tolist() == [[3, 2, 1]]
    assert rgb_rows(bytes([10, 20, 30, 40]), 1, 1, "Cmyk8").tolist() == [[205, 195, 185]] and rgb_rows(b"\x80", 2, 1, "Mono1").tolist() == [[255] * 3 + [0] * 3]
    with pytest.raises(ValueError):
        encode_page(rgb, 3, 2, 3, "tiff")
    docs = spark.createDataFrame([(1, build_pdf([b"0 0 9 9 re f"], 10, 10))], "doc_id long, content binary")
    write_pages(T.render(docs, 72.0), str(tmp_path), "pgm")
    assert [f for f in os.listdir(tmp_path) if not f.startswith(".")] == ["1-0001.pgm"]


def test_encrypted_is_refused(spark):
    data = build_pdf([b""]).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    row = T.pages(spark.createDataFrame([(1, data)], "doc_id long, content binary")).first()
    assert row["error_kind"] == "EncryptedDocument"


def test_modes_and_selection_of_pages(spark):
    data = build_pdf([b"1 0 0 rg 0 0 9 9 re f"] * 4, 10, 10)
    docs = spark.createDataFrame([(1, data)], "doc_id long, content binary")
    rgb = T.render(docs, 72.0, mode="rgb", parity="even").collect()
    assert [r["page_num"] for r in rgb] == [2, 4] and rgb[0]["channels"] == 3 and rgb[0]["pixels"][3 * (5 * 10 + 5) :][:3] == b"\xff\0\0"
    mono = T.render(docs, 72.0, first=2, last=2, mode="mono", deskew=True).first()
    assert set(mono["pixels"]) <= {0, 255} and mono["channels"] == 1 and mono["skew"] is not None
    for bad in ({"dpi": 0.0}, {"first": 0}, {"first": 3, "last": 2}, {"mode": "cmyk"}, {"mode": "rgb", "deskew": True}, {"dpi": float("nan")}):
        with pytest.raises(ValueError):
            T.render(docs, **bad)


def test_tables_of_a_document(spark):
    image = b"<< /Type /XObject /Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 2 >>\nstream\n\x00\xff\nendstream"
    odd = image.replace(b"/Length 2", b"/Filter /JPXDecode /Length 2")
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"
    data = build_pdf([b"BT /F 10 Tf 5 5 Td (Hi) Tj ET /I Do xx"], 50, 50, [image, odd, font], b"/Resources << /XObject << /I 5 0 R >> /Font << /F 7 0 R >> >> ", b"/OpenAction << /S /JavaScript >> ")
    docs = spark.createDataFrame([(1, data), (2, b"no")], "doc_id long, content binary")
    info = {r["doc_id"]: r for r in T.info(docs).collect()}
    assert (info[1]["version"], info[1]["n_pages"], info[1]["n_objects"], info[1]["js_locations"]) == ("1.4", 1, 7, "OpenAction") and info[2]["error_kind"] == "NotAPdf"
    scan = T.prescan(docs).where("doc_id = 1").first()
    assert scan["has_images"] and scan["has_vector_text"] and scan["dominant_filter"] == "Raw" and scan["unknown_ops"] == "xx" and scan["n_ops"] == 7 and scan["suggested_dpi"] == 150
    assert "".join(r["character"] for r in T.glyphs(docs).where("doc_id = 1").orderBy("k").collect()) == "Hi"
    assert [(r["obj_num"], r["status"], r["filter"]) for r in T.images(docs).where("doc_id = 1").orderBy("obj_num").collect()] == [(5, "Ok", "Raw"), (6, "Unsupported", "JPXDecode")]
    assert [(r["subtype"], r["base_font"], r["embedded"]) for r in T.fonts(docs).where("doc_id = 1").collect()] == [("Type1", "Helvetica", False)]
    assert sorted((r["node"], r["parent"], r["kind"]) for r in T.page_tree(docs).where("doc_id = 1").collect()) == [(2, None, "node"), (3, 2, "page")]
