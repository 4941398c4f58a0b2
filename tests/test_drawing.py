"""Strokes, text, images, shadings, patterns, groups, layers and deskew on pages made here."""

import math
import struct
import zlib

import numpy as np
import pytest

from quire.drawing import ccitt, deskew
from quire.drawing import images as I
from quire.drawing import paths as P
from quire.drawing.numbers import function
from quire.drawing.outlines import Charstring, open_face
from quire.drawing.text import FALLBACKS, base_encoding, character
from quire.sources.fixtures import build_pdf
from quire.sources.pdf import Document, Name, Stream
from quire.sources.raster_page import draw

RED, WHITE, BLACK = (255, 0, 0), (255, 255, 255), (0, 0, 0)


def stream(info: bytes, data: bytes) -> bytes:
    return b"<< " + info + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def page(content: bytes, extra=(), resources: bytes = b"", page_extra: bytes = b"", catalog: bytes = b"", size=100, **options):
    """Objects of ``extra`` are numbered from 5 on."""
    doc = Document(build_pdf([content], size, size, list(extra), b"/Resources << " + resources + b" >> " + page_extra, catalog))
    _, own_page, own = doc.pages()[0]
    return draw(doc, own_page, own, doc.geometry(own), 72, **options)


def at(p, x, y):
    """The pixel whose lower left corner is (x, y) in the page's space."""
    return tuple(int(v) for v in p.pixels[p.height - 1 - y, x])


@pytest.mark.parametrize("even_odd", [False, True])
def test_upright_rectangles_fill_as_any_path(monkeypatch, even_odd):
    rng = np.random.default_rng(7)
    cases = []
    for k in range(400):
        xa, xb, ya, yb = (rng.integers(-5, 25, 4) + (rng.integers(0, 4, 4) / 4 if k % 2 else 0.0)).tolist()
        cases.append([(xa, ya), (xb, ya), (xb, yb), (xa, yb)])
    fast = [P.fill_mask([c], 20, 20, even_odd) for c in cases]
    monkeypatch.setattr(P, "rectangle", lambda points: None)
    assert all((f == P.fill_mask([c], 20, 20, even_odd)).all() for f, c in zip(fast, cases))
    assert sum(f.any() for f in fast) > 150


def test_antialiased_edges_have_gray():
    p = page(b"0.5 g 10.5 10.5 20 20 re f", antialias=True)
    assert at(p, 20, 20) == (128, 128, 128)
    edge = at(p, 10, 20)[0]
    assert 128 < edge < 255
    shape = P.fill_shape([[(0, 0), (8, 0), (8, 8), (0, 8)]], 10, 10, False, True)
    assert shape.shape[4, 4] == 255


def test_stroke_caps_and_joins():
    butt, square = (page(b"10 w %d J 30 50 m 70 50 l S" % cap) for cap in (0, 2))
    assert at(butt, 50, 52) == BLACK and at(butt, 27, 50) == WHITE and at(square, 27, 50) == BLACK
    miter, bevel = (page(b"10 w %d j 20 20 m 50 20 l 50 60 l S" % join) for join in (0, 2))
    assert at(miter, 54, 16) == BLACK and at(bevel, 54, 16) == WHITE
    round_ = page(b"10 w 1 J 1 j 20 50 m 60 50 l S")
    assert at(round_, 17, 50) == BLACK and at(round_, 16, 54) == WHITE
    assert at(page(b"0 w 10 50 m 90 50 l S"), 40, 49) == BLACK or at(page(b"0 w 10 50 m 90 50 l S"), 40, 50) == BLACK


def test_dashes():
    parts = P.dashed([(0.0, 0.0), (20.0, 0.0)], False, [4.0, 2.0], 1.0)
    assert [(a[0][0], a[-1][0]) for a in parts] == [(0, 3), (5, 9), (11, 15), (17, 20)]
    assert P.dashed([(1.0, 1.0), (1.0, 1.0)], False, [3.0], 0.0) == [[(1.0, 1.0), (1.0, 1.0)]]
    assert len(P.dashed([(0.0, 0.0), (9.0, 0.0)], False, [], 0.0)) == 1
    p = page(b"4 w [10 10] 0 d 10 50 m 90 50 l S")
    assert at(p, 15, 50) == BLACK and at(p, 25, 50) == WHITE and at(p, 35, 50) == BLACK


def test_even_odd_clip_and_alpha():
    p = page(b"10 10 80 80 re 30 30 40 40 re W* n 1 0 0 rg 0 0 100 100 re f /G gs 0 0 1 rg 10 10 10 80 re f", resources=b"/ExtGState << /G << /ca 0.5 >> >>")
    assert at(p, 50, 50) == WHITE and at(p, 25, 50) == RED
    r, g, b = at(p, 14, 50)
    assert (g, abs(r - 127) <= 1, abs(b - 128) <= 1) == (0, True, True)


def test_colors_of_all_spaces():
    lookup = b"<FF000000FF000000FF>"
    extra = [b"<< /FunctionType 2 /Domain [0 1] /C0 [0 0 0 0] /C1 [0 1 1 0] /N 1 >>", stream(b"/N 3", b"")]
    spaces = b"/ColorSpace << /I [/Indexed /DeviceRGB 2 " + lookup + b"] /S [/Separation /Spot /DeviceCMYK 5 0 R] /L [/Lab << /WhitePoint [0.95 1 1.09] >>] /P [/ICCBased 6 0 R] >>"
    marks = [(b"/I cs 1 sc", (0, 255, 0)), (b"/S cs 1 scn", (255, 0, 0)), (b"/L cs 100 0 0 sc", None), (b"/P cs 0 0 1 sc", (0, 0, 255)), (b"0 1 0 0 k", (255, 0, 255))]
    content = b" ".join(c + b" %d 0 10 100 re f" % (20 * k) for k, (c, _) in enumerate(marks))
    p = page(content, extra, spaces)
    for k, (_, want) in enumerate(marks):
        if want:
            assert at(p, 20 * k + 5, 50) == want


def test_text_in_modes_and_positions():
    if not __import__("os").path.exists(FALLBACKS[0]):
        pytest.skip("no fallback font")
    font = b"/Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >> >>"
    p = page(b"BT /F 40 Tf 20 30 Td (I) Tj ET", resources=font)
    ink = np.argwhere(p.pixels[:, :, 0] < 128)
    assert 20 < ink[:, 1].mean() < 32 and 25 < ink[:, 0].max() - ink[:, 0].min() < 35
    assert [g[0] for g in p.glyphs] == ["I"] and p.glyphs[0][1:] == (20.0, 70.0, 40.0)
    hidden = page(b"BT /F 40 Tf 3 Tr 20 30 Td (I) Tj ET", resources=font)
    assert hidden.pixels.min() == 255 and hidden.seen.has_vector_text
    clipped = page(b"BT /F 40 Tf 7 Tr 20 30 Td (I) Tj ET 1 0 0 rg 0 0 100 100 re f", resources=font)
    red = np.argwhere((clipped.pixels == RED).all(axis=2))
    assert abs(len(red) - len(ink)) < 20
    moved = page(b"BT /F 10 Tf 14 TL 2 Tc 10 Tw 200 Tz 10 80 Td (a b) Tj T* [(x) -1000 (y)] TJ 5 5 Td (q) ' ET", resources=font)
    x = {g[0]: g[1] for g in moved.glyphs}
    w = {c: open_face(open(FALLBACKS[0], "rb").read()).advance(open_face(open(FALLBACKS[0], "rb").read()).characters[ord(c)]) for c in "a x"}
    assert x["b"] == pytest.approx(10 + 2 * ((w["a"] + w[" "]) / 100 + 2 * 2 + 10)) and x["y"] == pytest.approx(10 + 2 * (w["x"] / 100 + 2 + 10)) and x["q"] == 15


def test_embedded_truetype_and_widths():
    if not __import__("os").path.exists(FALLBACKS[0]):
        pytest.skip("no font")
    data = open(FALLBACKS[0], "rb").read()
    packed = zlib.compress(data)
    face = open_face(data)
    gid = face.characters[ord("H")]
    extra = [
        stream(b"/Filter /FlateDecode", packed),
        b"<< /Type /FontDescriptor /Flags 4 /FontFile2 5 0 R >>",
        b"<< /Type /Font /Subtype /CIDFontType2 /FontDescriptor 6 0 R /DW 500 /W [%d [900]] /CIDToGIDMap /Identity >>" % gid,
        b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [7 0 R] >>",
    ]
    p = page(b"BT /F 50 Tf 10 20 Td <%04X0001%04X> Tj ET" % (gid, gid), extra, b"/Font << /F 8 0 R >>")
    assert [g[1] for g in p.glyphs] == [10.0, 55.0, 80.0]
    assert at(p, 17, 38) == BLACK and at(p, 17, 75) == WHITE


def test_type3_glyphs_take_the_text_color():
    extra = [stream(b"", b"1000 0 0 0 750 750 d1 0 1 0 rg 0 0 750 750 re f")]
    font = b"/Font << /T << /Type /Font /Subtype /Type3 /FontMatrix [0.001 0 0 0.001 0 0] /CharProcs << /sq 5 0 R >> /Encoding << /Differences [97 /sq] >> /FirstChar 97 /Widths [1000] >> >>"
    p = page(b"1 0 0 rg BT /T 20 Tf 10 10 Td (aa) Tj ET", extra, font)
    assert at(p, 15, 15) == RED and at(p, 35, 15) == RED and at(p, 27, 15) == WHITE


def test_glyph_names():
    assert chr(character("eacute")) == "é" and chr(character("Scaron")) == "Š" and character("uni20AC") == 0x20AC and character("nothing") is None
    assert base_encoding("WinAnsiEncoding")[0xE9] == "eacute" and base_encoding("StandardEncoding")[0xAE] == "fi" and base_encoding("MacRomanEncoding")[0x8E] == "eacute"


def test_cff_charstring():
    number = lambda v: bytes([v + 139]) if -107 <= v <= 107 else b"\x1c" + struct.pack(">h", v)
    code = b"".join(map(number, [55, 10, 20])) + b"\x15" + b"".join(map(number, [100, 100, -100])) + b"\x06" + b"\x0e"
    pen = Charstring([], [])
    pen.run(code)
    assert pen.out == [("m", ((10.0, 20.0),)), ("l", ((110.0, 20.0),)), ("l", ((110.0, 120.0),)), ("l", ((10.0, 120.0),))]


def test_image_masks_and_decode():
    gray = bytes([0, 85, 170, 255])
    doc = Document(build_pdf([b""]))
    make = lambda info, data: I.resolve(doc, Stream({"Width": 2, "Height": 2, **info}, data))
    plain = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, gray)
    assert plain.rgb[:, :, 0].ravel().tolist() == [0, 85, 170, 255] and plain.alpha is None
    turned = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Decode": [1, 0]}, gray)
    assert turned.rgb[:, :, 0].ravel().tolist() == [255, 170, 85, 0]
    keyed = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Mask": [80, 180]}, gray)
    assert keyed.alpha.ravel().tolist() == [255, 0, 0, 255]
    soft = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "SMask": Stream({"Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x40")}, gray)
    assert (soft.alpha == 0x40).all()
    stencil = make({"ImageMask": True}, bytes([0b01000000, 0b10000000]))
    assert stencil.rgb is None and stencil.alpha.ravel().tolist() == [255, 0, 0, 255]
    masked = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8, "Mask": Stream({"Width": 2, "Height": 1, "ImageMask": True}, b"\x40")}, gray)
    assert masked.alpha.ravel().tolist() == [255, 0, 255, 0]
    palette = make({"ColorSpace": [Name("Indexed"), Name("DeviceRGB"), 1, bytes([1, 2, 3, 4, 5, 6])], "BitsPerComponent": 1}, bytes([0b01000000, 0b10000000]))
    assert palette.rgb[0].tolist() == [[1, 2, 3], [4, 5, 6]]
    sixteen = make({"ColorSpace": Name("DeviceGray"), "BitsPerComponent": 16}, bytes([255, 255, 0, 0, 128, 0, 0, 1]))
    assert sixteen.rgb[:, :, 0].ravel().tolist() == [255, 0, 128, 0]
    with pytest.raises(I.ImageError) as e:
        make({"Filter": Name("JPXDecode"), "ColorSpace": Name("DeviceGray")}, b"")
    assert e.value.kind == "Unsupported"


def test_stencil_takes_the_fill_color_and_box_scaling():
    p = page(b"1 0 0 rg q 40 0 0 40 20 20 cm BI /W 2 /H 1 /IM true ID \x40 EI Q")
    assert at(p, 25, 40) == RED and at(p, 50, 40) == WHITE
    assert I.box_scaled(np.array([[0, 100], [200, 100]], np.uint8), 1, 1).tolist() == [[100]]
    assert I.box_scaled(np.array([[7, 9]], np.uint8), 4, 2).tolist() == [[7, 7, 9, 9]] * 2


def tiff_strip(spark, bits: np.ndarray, kind: str) -> tuple[bytes, int]:
    """(coded data, K) of a fax image that the JVM writes as TIFF."""
    jvm, (h, w) = spark.sparkContext._jvm, bits.shape
    image = jvm.java.awt.image.BufferedImage(w, h, 12)
    for y in range(h):
        for x in range(w):
            image.getRaster().setSample(x, y, 0, int(bits[y, x]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    param.setCompressionMode(2)
    param.setCompressionType(kind)
    out = jvm.java.io.ByteArrayOutputStream()
    target = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(target)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    target.flush()
    data = bytes(out.toByteArray())
    order = "<" if data[:2] == b"II" else ">"
    ifd = struct.unpack_from(order + "I", data, 4)[0]
    tags = {}
    for k in range(struct.unpack_from(order + "H", data, ifd)[0]):
        tag, kind_, count = struct.unpack_from(order + "HHI", data, ifd + 2 + 12 * k)
        size = {1: 1, 3: 2, 4: 4}.get(kind_, 0) * count
        if size:
            place = ifd + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", data, ifd + 10 + 12 * k)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind_]}", data, place)
    strips = [data[a : a + n] for a, n in zip(tags[273], tags[279])]
    k = -1 if tags[259][0] == 4 else 1 if tags.get(292, (0,))[0] & 1 else 0
    rows = tags.get(278, (h,))[0]
    return [(s, min(rows, h - i * rows)) for i, s in enumerate(strips)], k, tags[262][0], tags.get(266, (1,))[0]


@pytest.mark.parametrize("kind", ["CCITT T.6", "CCITT T.4", "CCITT RLE"])
def test_fax_images(spark, kind):
    y, x = np.mgrid[0:40, 0:150]
    bits = (((x // 7 + y // 5) % 3 == 0) ^ ((x - 75) ** 2 + (y - 20) ** 2 < 250)).astype(np.uint8)
    strips, k, photometric, order = tiff_strip(spark, bits, kind)
    assert order == 1
    parts = [ccitt.decode(s, 150, n, k, byte_align=kind == "CCITT RLE") for s, n in strips]
    got = np.vstack(parts)
    assert (got == (bits if photometric == 0 else bits)).all() or (got == 1 - bits).all()


def test_fax_codes_are_prefix_free_and_damage_ends_quietly():
    for codes in ([*ccitt.WHITE, *ccitt.LONG], [*ccitt.BLACK, *ccitt.LONG]):
        assert len(set(codes)) == len(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert (len(ccitt.WHITE), len(ccitt.BLACK)) == (91, 91)
    assert ccitt.decode(b"\x00\x01\xff", 20, 4, -1).shape == (4, 20)


def test_functions_on_arrays():
    doc = Document(build_pdf([b""]))
    x = np.array([[0.0, 0.25, 1.0]])
    one = {"FunctionType": 2, "Domain": [0, 1], "C0": [0], "C1": [1], "N": 2}
    assert function(doc, one)(x).tolist() == [[0, 0.0625, 1]]
    both = {"FunctionType": 3, "Domain": [0, 1], "Functions": [one, one], "Bounds": [0.5], "Encode": [0, 1, 1, 0]}
    assert function(doc, both)(x)[0].tolist() == [0, 0.25, 0]
    samples = Stream({"FunctionType": 0, "Domain": [0, 1, 0, 1], "Range": [0, 1], "Size": [2, 2], "BitsPerSample": 8}, bytes([0, 255, 255, 0]))
    assert function(doc, samples)(np.array([[0, 1, 0.5], [0, 0, 0.5]]))[0].tolist() == [0, 1, 0.5]
    program = Stream({"FunctionType": 4, "Domain": [0, 1], "Range": [0, 1, 0, 1]}, b"{ dup 0.5 gt { 1 exch sub } if dup 2 mul }")
    assert function(doc, program)(x).tolist() == [[0, 0.25, 0], [0, 0.5, 0]]
    assert function(doc, {"FunctionType": 9}) is None


SHADE = b"/Function << /FunctionType 2 /Domain [0 1] /C0 [1 0 0] /C1 [0 0 1] /N 1 >>"


def test_axial_radial_and_function_shadings():
    p = page(b"/A sh", resources=b"/Shading << /A << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [20 0 80 0] /Extend [true false] " + SHADE + b" >> >>")
    assert at(p, 5, 50) == RED and at(p, 90, 50) == WHITE and abs(at(p, 50, 50)[0] - 127) < 4
    p = page(b"/A sh", resources=b"/Shading << /A << /ShadingType 3 /ColorSpace /DeviceRGB /Coords [50 50 0 50 50 40] " + SHADE + b" >> >>")
    assert at(p, 50, 50)[0] > 240 and at(p, 88, 50)[2] > 230 and at(p, 2, 2) == WHITE
    extra = [stream(b"/FunctionType 4 /Domain [0 1 0 1] /Range [0 1 0 1 0 1]", b"{ 0 }")]
    p = page(b"/A sh", extra, b"/Shading << /A << /ShadingType 1 /ColorSpace /DeviceRGB /Matrix [100 0 0 100 0 0] /Function 5 0 R >> >>")
    r, g, b = at(p, 80, 20)
    assert abs(r - 205) < 3 and abs(g - 52) < 3 and b == 0


def test_meshes_and_patches():
    def vertex(flag, x, y, r, g, b):
        return bytes([flag, x, y, r, g, b])

    info = b"/ColorSpace /DeviceRGB /BitsPerCoordinate 8 /BitsPerComponent 8 /BitsPerFlag 8 /Decode [0 255 0 255 0 1 0 1 0 1]"
    free = vertex(0, 10, 10, 255, 0, 0) + vertex(0, 90, 10, 255, 0, 0) + vertex(0, 10, 90, 255, 0, 0) + vertex(1, 90, 90, 255, 0, 0)
    p = page(b"/M sh", [stream(b"/ShadingType 4 " + info, free)], b"/Shading << /M 5 0 R >>")
    assert at(p, 20, 20) == RED and at(p, 80, 80) == RED and at(p, 95, 95) == WHITE
    rows = b"".join(bytes([x, y, 255, 0, 0]) for y in (10, 90) for x in (10, 90))
    p = page(b"/M sh", [stream(b"/ShadingType 5 /VerticesPerRow 2 " + info, rows)], b"/Shading << /M 5 0 R >>")
    assert at(p, 50, 50) == RED and at(p, 95, 50) == WHITE
    around = [(10, 10), (10, 40), (10, 60), (10, 90), (40, 90), (60, 90), (90, 90), (90, 60), (90, 40), (90, 10), (60, 10), (40, 10)]
    colors = [(255, 0, 0), (255, 0, 0), (0, 0, 255), (0, 0, 255)]
    coons = bytes([0]) + bytes(v for q in around for v in q) + bytes(v for c in colors for v in c)
    p = page(b"/M sh", [stream(b"/ShadingType 6 " + info, coons)], b"/Shading << /M 5 0 R >>")
    assert at(p, 12, 50)[0] > 240 and at(p, 88, 50)[2] > 240 and abs(at(p, 50, 50)[0] - 127) < 8 and at(p, 95, 95) == WHITE
    tensor = bytes([0]) + bytes(v for q in [*around, (40, 40), (40, 60), (60, 60), (60, 40)] for v in q) + bytes(v for c in colors for v in c)
    q = page(b"/M sh", [stream(b"/ShadingType 7 " + info, tensor)], b"/Shading << /M 5 0 R >>")
    assert np.abs(q.pixels.astype(int) - p.pixels).max() <= 12


def test_tiling_patterns():
    extra = [stream(b"/PatternType 1 /PaintType 1 /TilingType 1 /BBox [0 0 20 20] /XStep 20 /YStep 20 /Resources << >>", b"1 0 0 rg 0 0 9 20 re f"), stream(b"/PatternType 1 /PaintType 2 /TilingType 1 /BBox [0 0 20 20] /XStep 20 /YStep 20 /Resources << >>", b"0 0 9 20 re f")]
    names = b"/Pattern << /P 5 0 R /U 6 0 R >> /ColorSpace << /C [/Pattern /DeviceRGB] >>"
    p = page(b"/Pattern cs /P scn 0 0 100 50 re f /C cs 0 0 1 /U scn 0 50 100 50 re f", extra, names)
    assert at(p, 24, 25) == RED and at(p, 35, 25) == WHITE and at(p, 44, 75) == (0, 0, 255) and at(p, 55, 75) == WHITE
    p = page(b"/Pattern cs /S scn 0 0 100 50 re f", resources=b"/Pattern << /S << /PatternType 2 /Shading << /ShadingType 2 /ColorSpace /DeviceRGB /Coords [0 0 100 0] " + SHADE + b" >> >> >>")
    assert at(p, 2, 10)[0] > 245 and at(p, 97, 10)[2] > 240 and at(p, 50, 80) == WHITE


def test_groups_blend_modes_and_soft_masks():
    form = stream(b"/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Group << /S /Transparency /I true >>", b"1 0 0 rg 10 10 40 40 re f 0 0 1 rg 30 30 40 40 re f")
    p = page(b"/G gs /X Do", [form], b"/XObject << /X 5 0 R >> /ExtGState << /G << /ca 0.5 >> >>")
    assert at(p, 20, 20)[0] == 255 and abs(at(p, 20, 20)[1] - 127) <= 1
    r, g, b = at(p, 40, 40)  # the blue paint hides the red one within the group
    assert abs(r - 127) <= 1 and abs(g - 127) <= 1 and b >= 254
    p = page(b"1 1 0 rg 0 0 100 100 re f /M gs 0 1 1 rg 0 0 50 100 re f", resources=b"/ExtGState << /M << /BM /Multiply >> >>")
    assert at(p, 20, 20) == (0, 255, 0) and at(p, 70, 20) == (255, 255, 0)
    mask = stream(b"/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Group << /S /Transparency /CS /DeviceGray >>", b"1 g 0 0 50 100 re f")
    p = page(b"/S gs 1 0 0 rg 0 0 100 100 re f", [mask], b"/ExtGState << /S << /SMask << /S /Luminosity /G 5 0 R >> >> >>")
    assert at(p, 20, 50) == RED and at(p, 80, 50) == WHITE


def test_layers_and_annotations():
    ocg = b"<< /Type /OCG /Name (off) >>"
    p = page(b"/OC /L BDC 1 0 0 rg 0 0 50 100 re f EMC 0 0 1 rg 60 0 20 100 re f", [ocg], b"/Properties << /L 5 0 R >>", catalog=b"/OCProperties << /D << /OFF [5 0 R] >> >> ")
    assert at(p, 20, 50) == WHITE and at(p, 70, 50) == (0, 0, 255)
    look = stream(b"/Type /XObject /Subtype /Form /BBox [0 0 10 10]", b"1 0 0 rg 0 0 10 10 re f")
    annotation = b"<< /Type /Annot /Rect [20 20 60 40] /AP << /N << /On 5 0 R >> >> /AS /On >>"
    p = page(b"", [look, annotation, b"<< /Type /Annot /F 2 /Rect [0 60 9 90] /AP << /N 5 0 R >> >>"], page_extra=b"/Annots [6 0 R 7 0 R] ")
    assert at(p, 40, 30) == RED and at(p, 70, 30) == WHITE and at(p, 4, 80) == WHITE
    assert page(b"", [look, annotation], page_extra=b"/Annots [6 0 R] ", annotations=False).pixels.min() == 255


def test_forms_do_not_nest_forever():
    loop = stream(b"/Type /XObject /Subtype /Form /BBox [0 0 100 100] /Resources << /XObject << /X 5 0 R >> >>", b"0 0 9 9 re f /X Do")
    assert at(page(b"/X Do", [loop], b"/XObject << /X 5 0 R >>"), 4, 4) == BLACK


def test_prescan_draws_nothing():
    p = page(b"BT ET q 50 0 0 50 0 0 cm BI /W 100 /H 1 /BPC 1 /CS /G ID " + bytes(13) + b" EI Q xx", paints=False)
    assert p.pixels.size == 0 and p.seen.has_images and p.seen.max_ppi == 2.0 and p.unknown == {"xx"}


@pytest.mark.parametrize("degrees", [-3.0, 1.5, 5.0])
def test_skew_is_found_and_taken_out(degrees):
    h, w = 400, 500
    y, x = np.mgrid[0:h, 0:w]
    lines = np.where((y - 60) % 20 < 6, 0, 255).astype(np.uint8)
    lines[:60], lines[-60:], lines[:, :60], lines[:, -60:] = 255, 255, 255, 255
    skewed = deskew.rotated(lines, degrees)
    found = deskew.angle(skewed)
    assert abs(abs(found) - abs(degrees)) < 0.3
    straight, angle = deskew.straightened(skewed)
    assert angle == found and deskew.score(deskew.reduced(straight), 0.0) > 3 * deskew.score(deskew.reduced(skewed), 0.0)
    assert deskew.straightened(np.full((50, 50), 255, np.uint8))[1] == 0.0


def test_rotation_keeps_quarter_turns_exact():
    g = np.arange(25, dtype=np.uint8).reshape(5, 5)
    assert (deskew.rotated(g, 0.0)[:4, :4] == g[:4, :4]).all()
    assert math.isclose(float(deskew.rotated(g, 180.0)[2, 2]), 12.0)
