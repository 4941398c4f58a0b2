"""JPEG against the JVM's codec, character maps, calculator programs and the data source."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.pdf_function import CalculatorError, calculator
from quire.sources import jpeg
from quire.sources.fixtures import build_pdf
from quire.sources.fonts import advance, cid_widths, cmap, differences
from quire.sources.pdf import Name


def jvm_jpeg(spark, pixels: np.ndarray, progressive: bool = False) -> tuple[bytes, np.ndarray]:
    """(file, pixels that the JVM reads from it)."""
    jvm, (h, w) = spark.sparkContext._jvm, pixels.shape[:2]
    gray = pixels.ndim == 2
    image = jvm.java.awt.image.BufferedImage(w, h, 10 if gray else 1)
    for y in range(h):
        for x in range(w):
            r, g, b = (int(pixels[y, x]),) * 3 if gray else map(int, pixels[y, x])
            if gray:
                image.getRaster().setSample(x, y, 0, r)
            else:
                image.setRGB(x, y, r << 16 | g << 8 | b)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    target = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(target)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    target.flush()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    if gray:
        return data, np.array([[[back.getRaster().getSample(x, y, 0)] for x in range(w)] for y in range(h)])
    return data, np.array([[[back.getRGB(x, y) >> s & 255 for s in (16, 8, 0)] for x in range(w)] for y in range(h)])


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("shape", [(16, 16), (13, 21), (16, 16, 3), (19, 10, 3), (40, 37)])
def test_jpeg(spark, shape, progressive):
    y, x = np.mgrid[0 : shape[0], 0 : shape[1]]
    plain = (x * 9 + y * 5) % 256 // 2 + 40
    pixels = plain if len(shape) == 2 else np.stack([plain, 200 - plain, plain // 2 + 60], axis=2)
    data, want = jvm_jpeg(spark, pixels, progressive)
    head = jpeg.read_header(data, to_scan=False)
    assert (head.kind, head.height, head.width) == ("progressive" if progressive else "baseline", shape[0], shape[1])
    got = jpeg.decode(data).astype("i4")
    limit = 3 if len(shape) == 2 else 40  # chroma is upsampled without smoothing
    assert got.shape == want.shape and np.abs(got - want).max() <= limit and np.abs(got - want).mean() < limit / 3


def test_damaged_jpegs_fail_by_name(spark):
    files = [jvm_jpeg(spark, np.full((16, 16), 90), p)[0] for p in (False, True)]
    rng = random.Random(2)
    for k in range(120):
        data = files[k % 2]
        b = bytearray(data)
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(2, len(b))] = rng.randrange(256)
        try:
            jpeg.decode(bytes(b[: rng.randint(4, len(b))]))
        except (jpeg.JpegError, IndexError, ValueError):
            pass


def test_cmap_and_widths():
    data = b"2 begincidchar <01> 5 <02> 9 endcidchar 2 begincidrange <10> <12> 100 <0000> <FFFF> 1 endcidrange 1 beginbfrange <20> <21> [<0041> <0042>] endbfrange"
    assert dict(cmap(data)) == {1: 5, 2: 9, 16: 100, 17: 101, 18: 102, 32: 65, 33: 66}
    assert cid_widths([3, [500, 600.5], 10, 20, 700, -1, [5]]) == [(0, 3, 4, [500, 0]), (1, 10, 20, [700])]
    assert differences({65: "A"}, [66, Name("x"), Name("y"), 65, Name("z")]) == {65: "z", 66: "x", 67: "y"}
    assert advance([500, 250], 10, 1, 2, 1.5, [False, True]) == pytest.approx((5 + 1) * 1.5 + (2.5 + 1 + 2) * 1.5)


@pytest.mark.parametrize(
    ("program", "want"),
    [("{ 2 mul }", [6]), ("{ pop 7 3 idiv -7 2 mod }", [2, -1]), ("{ pop 1 2 3 3 1 roll }", [3, 1, 2]), ("{ pop 1 2 3 3 -1 roll }", [2, 3, 1]), ("{ 5 2 copy add }", [3, 5, 8]),
     ("{ 4 exch 1 index }", [4, 3, 4]), ("{ 3 eq { 1 } { 2 } ifelse }", [1]), ("{ pop 1 8 bitshift 6 3 xor true { 9 } if }", None), ("{ pop -1 0 atan 2 3 exp }", [270, 8]), ("{ pop 2.5 round -2.5 truncate 2.1 ceiling }", [3, -2, 3])],
)
def test_calculator(spark, program, want):
    x = F.col("x")
    if want is None:
        with pytest.raises(CalculatorError):
            calculator(program, [x])
        return
    row = spark.createDataFrame([(3.0,)], "x double").select(*[c.alias(f"c{i}") for i, c in enumerate(calculator(program, [x]))]).first()
    assert [pytest.approx(v) for v in want] == list(row)


@pytest.mark.parametrize("program", ["{ add }", "{ true add }", "{ frob }", "{ 1 2", "{ 1 x copy }", "{ { 1 } }"])
def test_bad_programs(program):
    with pytest.raises(CalculatorError):
        calculator(program, [])


def test_data_source(spark, tmp_path):
    from quire.sources.datasource import register

    (tmp_path / "a.pdf").write_bytes(build_pdf([b"0 0 %d 9 re f" % (i + 3) for i in range(5)], 20, 10))
    (tmp_path / "b.pdf").write_bytes(b"nothing")
    register(spark)
    df = spark.read.format("pdf").option("dpi", "72").option("pages_per_partition", "2").load(str(tmp_path / "*.pdf"))
    rows = df.collect()
    assert sorted(r["page_num"] for r in rows if r["page_num"]) == [1, 2, 3, 4, 5]
    assert [r["error_kind"] for r in rows if r["error_kind"]] == ["NotAPdf"]
    assert [r["page_num"] for r in df.where("page_num = 4").collect()] == [4]
    many = spark.read.format("pdf").option("dpi", "72").option("bytes_per_partition", "600").load(str(tmp_path / "*.pdf"))
    assert many.rdd.getNumPartitions() > 2 and sorted(map(str, many.drop("pixels").collect())) == sorted(map(str, df.drop("pixels").collect()))


def test_mutants_of_all_kinds_of_files(spark, tmp_path):
    """Every damaged file gives rows, in the data source as in the tables, and none stops the job."""
    import random
    import zlib

    from quire.sources import pdf_tables as T
    from quire.sources.datasource import register

    packed = zlib.compress(b"q 1 0 0 1 5 5 cm 0 0 10 10 re f Q BT /F 9 Tf (x) Tj ET sh BI /W 2 /H 2 /BPC 8 /CS /G ID abcd EI")
    stream = b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(packed) + packed + b"\nendstream"
    image = b"<< /Type /XObject /Subtype /Image /Width 4 /Height 2 /BitsPerComponent 2 /ColorSpace [/Indexed /DeviceRGB 3 <000000ff000000ff000000ff>] /Filter /LZWDecode /DecodeParms << /Predictor 12 /Columns 1 >> /Length 5 >>\nstream\n\x80\x0b\x60\x50\x22\nendstream"
    fax = b"<< /Subtype /Image /Width 16 /Height 4 /ImageMask true /Filter /CCITTFaxDecode /DecodeParms << /K -1 /Columns 16 >> /Length 4 >>\nstream\n\x26\xa0\xbf\x01\nendstream"
    seeds = [
        build_pdf([b"/I Do /J Do q 3 w 0 0 m 5 5 l S Q /P gs"], 40, 30, [image, fax], b"/Resources << /XObject << /I 5 0 R /J 6 0 R >> >> "),
        build_pdf([b"", b"0 0 5 5 re f"], 40, 30, [stream], b"/Contents 7 0 R /Rotate 90 "),
        build_pdf([b"BT /F 12 Tf 1 0 0 1 3 3 Tm [(ab) -50 (c)] TJ T* (d) ' ET"], 40, 30, [], b"/Resources << /Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Times >> >> >> "),
    ]
    rng, mutants = random.Random(23), []
    for i in range(1200):
        b = bytearray(seeds[i % 3])
        for _ in range(rng.randint(1, 6)):
            kind, at = rng.randrange(4), rng.randrange(len(b))
            if kind == 0:
                b[at] = rng.randrange(256)
            elif kind == 1:
                del b[at : at + rng.randint(1, 30)]
            elif kind == 2:
                b[at:at] = rng.choice([b"/", b"<<", b">>", b"-1 ", b"99999999999 ", b"0 R ", b"null ", b"(", b"[", b"1e99 "])
            else:
                to = rng.randrange(len(b))
                b[at:at] = b[to : to + rng.randint(1, 40)]
        mutants.append((i, bytes(b)))
    docs = spark.createDataFrame(mutants, "doc_id long, content binary").repartition(4)
    for table in (lambda d: T.render(d, 72.0, seconds=5.0), T.pages, T.xref, T.objects, T.operators, T.prescan, T.info, T.page_tree, T.glyphs, T.images, T.fonts):
        table(docs).count()
    rows = T.render(docs, 72.0, seconds=5.0).collect()
    assert all(r["error_kind"] or len(r["pixels"]) == r["width"] * r["height"] for r in rows)
    for i, data in mutants[:300]:
        (tmp_path / f"{i:04}.pdf").write_bytes(data)
    register(spark)
    found = spark.read.format("pdf").option("dpi", "72").option("bytes_per_partition", "500").option("page_seconds", "5").load(str(tmp_path / "*.pdf"))
    assert found.select("doc_id").distinct().count() == 300


def test_arithmetic_decoder_of_the_standard():
    """The test sequence of the JBIG2 standard: one context, 256 bits."""
    from quire.drawing.jbig2 import Decoder

    coded = bytes.fromhex("84C73BFCE1A1430402200000410DBB86F4317FFF88FF37471ADB6ADFFFAC")
    plain = bytes.fromhex("00020051000000C0035287 2AAAAAAAAA82C02000FCD79EF6BF7FED904F46A3BF".replace(" ", ""))
    decoder, contexts = Decoder(coded), [0]
    bits = [decoder.bit(contexts, 0) for _ in range(256)]
    assert bytes(int("".join(map(str, bits[i : i + 8])), 2) for i in range(0, 256, 8)) == plain


@pytest.mark.parametrize("template, places", [(0, None), (1, None), (2, None), (3, None), (0, [(5, -1), (-4, -2), (2, -2), (-2, -2)]), (1, [(-3, 0)])])
@pytest.mark.parametrize("like_above", [False, True])
def test_jbig2_generic_regions(template, places, like_above):
    import random

    from quire.drawing.jbig2 import decode
    from quire.sources.fixtures import jbig2_region

    rng = random.Random(template)
    for width, height in ((1, 1), (3, 2), (37, 23), (64, 40)):
        rows = [[int(rng.random() < 0.5 if (x // 8 + y // 5) % 2 else (x + y) % 7 == 0) for x in range(width)] for y in range(height)]
        rows[1:2] = [list(rows[0])] * (height > 1)
        got = decode(jbig2_region(rows, template, places, like_above), b"", width, height)
        assert (1 - got).tolist() == rows


def test_jbig2_symbols_and_text():
    """Two letters from a dictionary, set twice, one of them refined; the dictionary is shared."""
    import numpy as np

    from quire.drawing import jbig2 as J
    from quire.sources.fixtures import ArithmeticWriter, jbig2_segment

    letters = [[[1, 0, 1], [1, 1, 1]], [[0, 1, 1, 0], [1, 0, 0, 1]]]
    w = ArithmeticWriter()
    numbers, shapes = J.Numbers(w), [0] * (1 << 16)

    def put(kind, value):
        w.integer(value, J.RANGES)
        assert numbers.read(kind) == value

    put("DH", 2)
    for step, letter in ((3, letters[0]), (1, letters[1])):
        put("DW", step)
        w.put([v for row in letter for v in row])
        J.generic(w, shapes, len(letter[0]), 2, 1, [(3, -1)])
    put("DW", None)
    put("EX", 0)
    put("EX", 2)
    dictionary = jbig2_segment(0, 0, (1 << 10).to_bytes(2, "big") + bytes([3, 255]) + (2).to_bytes(4, "big") * 2 + w.finish())
    assert J.symbols(dictionary[11:], []) == letters

    w = ArithmeticWriter()
    numbers, shades = J.Numbers(w), [0] * (1 << 13)
    put("DT", 0)
    put("DT", 3)
    put("FS", 2)
    better = [[1, 1, 1], [1, 0, 1]]
    for k, (symbol, step) in enumerate(((0, 5), (1, 200), (0, None))):
        w.put([symbol])
        assert numbers.symbol(1) == symbol
        put("RI", int(k == 2))
        if k == 2:
            for kind in ("RDW", "RDH", "RDX", "RDY"):
                put(kind, 0)
            w.put([v for row in better for v in row])
            J.refined(w, shades, 3, 2, 1, letters[0], 0, 0, [])
        put("DS", step)
    flags = 1 << 15 | 1 << 4 | 2  # refined by the small template, placed by the top left corner
    head = (240).to_bytes(4, "big") + (9).to_bytes(4, "big") + (4).to_bytes(4, "big") + (1).to_bytes(4, "big") + b"\0"
    page = jbig2_segment(1, 6, head + flags.to_bytes(2, "big") + (3).to_bytes(4, "big") + w.finish(), b"\0")
    got = 1 - J.decode(page, dictionary, 260, 12)
    want = np.zeros((12, 260), np.uint8)
    x = 4 + 2
    for shape, gap in ((letters[0], 5), (letters[1], 200), (better, 0)):
        want[1 + 3 : 1 + 5, x : x + len(shape[0])] |= np.array(shape, np.uint8)
        x += len(shape[0]) - 1 + gap
    assert (got == want).all()


def test_damaged_jbig2_fails_by_name():
    import random

    from quire.drawing.jbig2 import Jbig2Error, decode
    from quire.sources.fixtures import jbig2_region

    seed, rng = jbig2_region([[int((x * y) % 3 == 0) for x in range(30)] for y in range(20)]), random.Random(8)
    for _ in range(400):
        b = bytearray(seed)
        for _ in range(rng.randint(1, 4)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        try:
            assert decode(bytes(b[: rng.randint(1, len(b))]), b"", 30, 20).shape == (20, 30)
        except Jbig2Error:
            pass
