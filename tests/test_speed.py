"""What makes reading and drawing quick gives what it gave before."""

import numpy as np

from quire.drawing import paths
from quire.drawing.page import draw
from quire.sources import pdf_tables as T
from quire.sources.fixtures import build_pdf
from quire.sources.pdf import KNOWN, MOST_KNOWN, Document, Lexer, Ref, content_ops


def test_dictionaries_read_by_runs():
    read = lambda data: Lexer(data).read()
    assert read(b"<< /A? /B:c /D%x\n 3 0 R/E 3 0 Rx /F -1./G .5 /H#41 /I /J /#4b /L (m) >>") == {"A?": "B:c", "D": Ref(3, 0), "E": 3, "F": -1.0, "G": 0.5, "HA": "I", "J": "K", "L": b"m"}
    assert read(b"<< /A 1 /A 2 /B [1 -2. .5] /C [1 0 R 2] /D") == {"A": 2, "B": [1, -2.0, 0.5], "C": [Ref(1, 0), 2]}
    assert [(o.keyword, o.operands) for o in content_ops(b"/N 1 2 re f\n3. .5x BIx true 4 w BI /W 1 ID z EI Q")] == [("re", ["N", 1, 2]), ("f", []), (".5x", [3.0]), ("BIx", []), ("w", [True, 4]), ("BI", [{"Width": 1}, b"z"]), ("Q", [])]


def test_known_dictionaries_are_bounded_and_of_each_file_alone():
    first, second = (Document(build_pdf([b""], page_extra=b"/K (endobj) ")) for _ in range(2))
    assert first.get(Ref(1, 0)) == second.get(Ref(1, 0)) and first.get(Ref(1, 0)) is not second.get(Ref(1, 0))
    assert first.get(Ref(3, 0))["K"] == b"endobj"
    for k in range(MOST_KNOWN + 9):
        assert Document(build_pdf([b""], page_extra=b"/K %d " % k)).get(Ref(3, 0))["K"] == k
    assert len(KNOWN) <= MOST_KNOWN


def test_boxes_are_filled_as_by_scan_conversion():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x, y, w, h = rng.integers(-300, 900, 4) / 4.0
        doc = Document(build_pdf([b"0.5 g %r %r %r %r re f" % (float(x), float(y), float(w), float(h))]))
        (_, page, own), = doc.pages()
        got = draw(doc, page, own, doc.geometry(own), 72.0).pixels[..., 0]
        box = [(x, 100 - y), (x + w, 100 - y), (x + w, 100 - y - h), (x, 100 - y - h)]
        want = paths.fill_shape([box, [(-9.0, -9.0)]], 200, 100, False).shape  # two paths: no short way
        place = paths.fill_shape([box, [(-9.0, -9.0)]], 200, 100, False).place
        full = np.full((100, 200), 255, np.uint8)
        full[place][want > 0] = 128
        assert (got == full).all()


def test_image_files_do_not_leave_their_task(spark):
    from quire.plans import library

    for name in ("ppm_encode_bytes", "ppm_encode_colors", "pbm_encode_ink", "png_roundtrip", "pdf_info"):
        plan = library.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "pixels" not in plan and "content" not in plan


def test_files_made_or_stored_give_the_same(spark):
    rows = [(1, b"q 0.5 g 1 2 30 40 re f Q"), (2, b"")]
    stored = spark.createDataFrame([(k, bytearray(build_pdf([c]))) for k, c in rows], "doc_id long, content binary")
    made = T.Files(spark.createDataFrame([(k, bytearray(c)) for k, c in rows], "doc_id long, c binary"), T.of_each(lambda b: (build_pdf([c.as_py()]) for c in b.column("c"))))
    assert sorted(T.render(stored, 72.0).collect()) == sorted(T.render(made, 72.0).collect())
    assert T.info(made, ["n_pages"]).columns == ["doc_id", "n_pages"]


def test_paeth_rows_by_runs():
    from quire.sources import filters as Z
    from quire.sources.sinks import png

    rng, tried = np.random.default_rng(1), 0
    for k in range(300):
        step, n, levels = int(rng.integers(1, 5)), int(rng.integers(0, 400)), int(rng.choice([2, 3, 256]))
        stride = step * int(rng.integers(1, 20))
        data = (rng.integers(0, levels, n) * (rng.random(n) < rng.random())).astype(np.uint8)
        data[:: stride + 1] = rng.choice([2, 4], len(data[:: stride + 1])) if k % 2 else 4
        above, want = [0] * stride, []
        for at in range(0, n, stride + 1):  # a byte at a time
            row = [*data[at + 1 : at + 1 + stride].tolist()]
            row += [0] * (stride - len(row))
            for i in range(stride):
                a, b, c = (row[i - step] if i >= step else 0), above[i], (above[i - step] if i >= step else 0)
                row[i] = (row[i] + (b if data[at] == 2 else Z.paeth(a, b, c))) & 255
            want, above, tried = want + row, row, tried + 1
        assert Z.predicted(data.tobytes(), 15, step, 8, stride // step) == bytes(want)
        page = np.repeat(rng.integers(0, levels, (6, 3 * 7)).astype(np.uint8), 2, axis=0)
        file = png(page, 2)
        assert Z.flate(file[file.index(b"IDAT") + 4 : -16])[0] == 4 and Z.predicted(Z.flate(file[file.index(b"IDAT") + 4 : -16]), 15, 3, 8, 7) == page.tobytes()
    assert tried > 1000


def test_drawings_go_on_over_batches_and_hold_equal_marks_once(spark, tmp_path):
    import duckdb

    from quire.plans import library

    path, con = str(tmp_path), duckdb.connect()
    con.execute(f"COPY (SELECT l_orderkey // 40 AS l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag FROM '/root/testdata/sf0.001/lineitem.parquet', range(2)) TO '{path}/lineitem.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{path}/lineitem.parquet'")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name in ("ops_decode", "pdf_fill_dark_pixels"):
            got = sorted(map(tuple, library.queries()[name](spark, path).collect()))
            assert got == sorted(con.sql(library.oracle_sql()[name]).fetchall()) and len(got) == 38
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jittered_pixels_are_the_columns(spark):
    from pyspark.sql import functions as F

    from quire.operators import coverage as V

    rng = np.random.default_rng(4)
    rows = [(k, [tuple(map(float, e)) for e in rng.integers(-8, 40, (int(rng.integers(0, 6)), 4)) / 8]) for k in range(60)]
    shapes = spark.createDataFrame(rows, "shape long, edges array<struct<x0:double,y0:double,x1:double,y1:double>>")
    grid = shapes.withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(3))))
    for rule in (False, True):
        want = grid.select("shape", "px", "py", V.jittered_coverage(F.col("edges"), F.col("px"), F.col("py"), rule).alias("coverage"))
        got = V.jittered_pixels(shapes, 3, 4, rule)
        assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_wound_pixels_are_those_of_spans(spark):
    from quire.operators import raster as R

    rng = np.random.default_rng(5)
    rows = []
    for k in range(700):
        lo = int(rng.integers(-20, 40))
        rows.append((None if k % 9 == 0 else int(rng.integers(0, 4)), int(rng.integers(-2, 3)), lo, lo + int(rng.integers(0, 6)), int(rng.integers(-1, 2)), k))
    crossings = spark.createDataFrame(rows, "paint long, y long, lo long, hi long, cnt long, seg long").repartition(3)
    for size in ("3", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        for rule in (False, True):
            want = R.covered_pixels(R.spans(crossings.fillna({"paint": -1}), ["paint"], rule), ["paint"]).collect()
            got = R.wound_pixels(crossings, ["paint"], rule).collect()
            assert sorted((-1 if p is None else p, n) for p, n in got) == sorted(map(tuple, want)) and len(got) == 5
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_one_large_mesh_is_streamed(spark):
    import time

    from pyspark.sql import functions as F

    from quire.operators import coverage as V

    n = 60_000  # copied for each triangle this would take minutes
    vertices = spark.range(n).select(F.lit("m").alias("mesh"), F.col("id").alias("seq"), F.when(F.col("id") < 3, 0).otherwise(F.col("id") % 4).cast("int").alias("flag"))
    began = time.time()
    got = V.mesh_triangles(vertices, ["mesh"]).orderBy("t").collect()
    assert time.time() - began < 30
    flags, opened, last, want = [0 if k < 3 else k % 4 for k in range(n)], [], None, []
    for k, flag in enumerate(flags):
        if opened or flag == 0:
            opened.append(k)
            if len(opened) == 3:
                last, opened = tuple(opened), []
                want.append(last)
        elif last and flag in (1, 2):
            last = (last[1], last[2], k) if flag == 1 else (last[2], last[0], k)
            want.append(last)
    assert [(r["a"], r["b"], r["c"]) for r in got] == want and [r["t"] for r in got] == list(range(len(want)))


def test_type1_bytes_are_decrypted_together():
    from quire.drawing.type1 import CHARSTRING_KEY, EEXEC_KEY, decrypted, encrypted

    rng = np.random.default_rng(6)
    for n in (0, 1, 5, 1020, 1030, 40_000):
        data = rng.integers(0, 256, n).astype(np.uint8).tobytes()
        assert all(decrypted(encrypted(data, key), key, 4) == data for key in (EEXEC_KEY, CHARSTRING_KEY))


def test_likelier_bits_decoded_in_place():
    from quire.drawing.jbig2 import TEMPLATES, Decoder, generic

    class Plain(Decoder):  # goes bit by bit
        pass

    rng = np.random.default_rng(7)
    for k in range(40):
        data, places = rng.integers(0, 256, 300).astype(np.uint8).tobytes(), [(dx, dy) for _, dx, dy in TEMPLATES[k % 4][5]]
        ends, found = [], []
        for kind in (Decoder, Plain):
            decoder, contexts = kind(data), bytearray(1 << 16)
            found.append(generic(decoder, contexts, 30, 25, k % 4, places, k % 8 > 3))
            ends.append((decoder.a, decoder.c, decoder.at, decoder.left, contexts))
        assert found[0] == found[1] and ends[0] == ends[1]


def test_fonts_are_read_once_a_document(spark, monkeypatch):
    from quire.drawing import text

    page = b"/Resources << /Font << /F 9 0 R >> >> "
    data = build_pdf([b"BT /F 8 Tf 5 50 Td (ab) Tj ET"] * 3, extra=[b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 97 /Widths [500 600.5] >>"], page_extra=page)
    calls, resolve = [], text.resolve
    monkeypatch.setattr(text, "resolve", lambda doc, info: calls.append(1) or resolve(doc, info))
    doc = Document(data)
    pens = [draw(doc, page, own, doc.geometry(own), 72.0, paints=False).glyphs for _, page, own in doc.pages()]
    assert len(calls) == 1 and pens[0] == pens[1] == pens[2] and [g[0] for g in pens[0]] == ["a", "b"] and [r[5] for r in T.font_rows(doc)] == [2]
