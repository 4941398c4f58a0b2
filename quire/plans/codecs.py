"""Queries of calculator words, stream filters, file structures, image files, images and marks on
pages, each over a whole table."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pdf_function as P
from quire.plans.documents import RECTS, _PIXELS, built, dealt, drawings
from quire.plans.registry import query, table
from quire.sources import pdf_tables as T
from quire.sources.filters import decode_chain
from quire.sources.fixtures import build_pdf

#: Column -> (program on ``a b``, the same in SQL). a: -48 to 48 in quarters, b: -6 to 6, i and j whole.
WORDS = {
    "w_abs": ("a abs", "abs(a)"), "w_neg": ("a neg", "-a"), "w_ceiling": ("a ceiling", "ceil(a)"), "w_floor": ("a floor", "floor(a)"),
    "w_round": ("a round", "sign(a) * floor(abs(a) + 0.5)"), "w_truncate": ("a truncate", "trunc(a)"), "w_cvi": ("a cvi", "trunc(a)"), "w_cvr": ("a cvr", "a"),
    "w_sqrt": ("a abs sqrt", "sqrt(abs(a))"), "w_sin": ("a sin", "sin(radians(a))"), "w_cos": ("a cos", "cos(radians(a))"), "w_ln": ("a abs 1 add ln", "ln(abs(a) + 1)"), "w_log": ("a abs 1 add log", "log10(abs(a) + 1)"),
    "w_add": ("a b add", "a + b"), "w_sub": ("a b sub", "a - b"), "w_mul": ("a b mul", "a * b"), "w_div": ("a b abs 1 add div", "a / (abs(b) + 1)"),
    "w_idiv": ("a b abs 1 add idiv", "trunc(trunc(a) / (abs(b) + 1))"), "w_mod": ("a b abs 1 add mod", "trunc(a) - (abs(b) + 1) * trunc(trunc(a) / (abs(b) + 1))"),
    "w_atan": ("a b atan", "CASE WHEN atan2(a, b) < 0 THEN degrees(atan2(a, b)) + 360 ELSE degrees(atan2(a, b)) END"), "w_exp": ("a abs b 4 div exp", "pow(abs(a), b / 4)"),
    "w_eq": ("a b eq { 1 } { 0 } ifelse", "CASE WHEN a = b THEN 1 ELSE 0 END"), "w_ne": ("a b ne { 1 } { 0 } ifelse", "CASE WHEN a <> b THEN 1 ELSE 0 END"),
    "w_gt": ("a b gt { 1 } { 0 } ifelse", "CASE WHEN a > b THEN 1 ELSE 0 END"), "w_ge": ("a b ge { 1 } { 0 } ifelse", "CASE WHEN a >= b THEN 1 ELSE 0 END"),
    "w_lt": ("a b lt { 1 } { 0 } ifelse", "CASE WHEN a < b THEN 1 ELSE 0 END"), "w_le": ("a b le { 1 } { 0 } ifelse", "CASE WHEN a <= b THEN 1 ELSE 0 END"),
    "w_and": ("a abs cvi b abs cvi and", "CAST(trunc(abs(a)) AS BIGINT) & CAST(abs(b) AS BIGINT)"), "w_or": ("a abs cvi b abs cvi or", "CAST(trunc(abs(a)) AS BIGINT) | CAST(abs(b) AS BIGINT)"),
    "w_xor": ("a abs cvi b abs cvi xor", "xor(CAST(trunc(abs(a)) AS BIGINT), CAST(abs(b) AS BIGINT))"), "w_not": ("a cvi not", "-CAST(trunc(a) AS BIGINT) - 1"),
    "w_bool_and": ("a 0 gt b 0 gt and { 1 } { 0 } ifelse", "CASE WHEN a > 0 AND b > 0 THEN 1 ELSE 0 END"), "w_bool_or": ("a 0 gt b 0 gt or { 1 } { 0 } ifelse", "CASE WHEN a > 0 OR b > 0 THEN 1 ELSE 0 END"),
    "w_bool_xor": ("a 0 gt b 0 gt xor { 1 } { 0 } ifelse", "CASE WHEN (a > 0) <> (b > 0) THEN 1 ELSE 0 END"), "w_bool_not": ("a 0 gt not { 1 } { 0 } ifelse", "CASE WHEN a > 0 THEN 0 ELSE 1 END"),
    "w_bitshift": ("a abs cvi 3 bitshift", "CAST(trunc(abs(a)) AS BIGINT) * 8"), "w_shift_down": ("a abs cvi -2 bitshift", "CAST(floor(trunc(abs(a)) / 4) AS BIGINT)"),
    "w_true": ("true { a } { b } ifelse", "a"), "w_false": ("false { a } { b } ifelse", "b"), "w_if": ("a b a 0 lt { pop 7 } if add", "a + CASE WHEN a < 0 THEN 7 ELSE b END"),
    "w_dup": ("a dup add", "a + a"), "w_exch": ("a b exch sub", "b - a"), "w_pop": ("a b pop", "a"), "w_copy": ("a b 2 copy mul add sub", "a - (b + a * b)"),
    "w_index": ("a b 1 index sub sub", "a - (b - a)"), "w_roll": ("a b 9 3 1 roll sub sub", "9 - (a - b)"), "w_roll_down": ("a b 9 3 -1 roll sub sub", "b - (9 - a)"),
}


@query("calculator_words", "WITH e AS (SELECT event_id, (event_id * 7 % 385 - 192) / 4.0::DOUBLE AS a, (event_id % 13 - 6)::DOUBLE AS b FROM events) SELECT event_id, " + ", ".join(f"round(CAST({sql} AS DOUBLE), 6) + 0.0 AS {name}" for name, (_, sql) in WORDS.items()) + " FROM e")
def calculator_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of calculator programs."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", ((n * 7 % 385 - 192) / F.lit(4.0)).alias("a"), (n % 13 - 6).cast("double").alias("b"))

    def value(program: str) -> Column:
        # Names of inputs are no words: each is fetched from below by its depth.
        compiler = P.Compiler([])
        run, inputs = compiler.word, {"a": F.col("a"), "b": F.col("b")}
        compiler.word = lambda w: compiler.stack.append(("n", inputs[w])) if w in inputs else run(w)
        compiler.run(P.parse("{ " + program + " }"))
        return P.column(compiler.stack[-1])

    return rows.select("event_id", *[(F.round(value(program), 6) + F.lit(0.0)).alias(name) for name, (program, _) in WORDS.items()])


# Filters, each undone after a plain encoder of its own.


def lzw_codes(data: bytes) -> bytes:
    """Nine-bit codes of single bytes, cleared before the codes grow."""
    codes = [256]
    for i in range(0, len(data), 200):
        codes += [*data[i : i + 200], 256]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def ascii85(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 4):
        group = data[i : i + 4]
        value, digits = int.from_bytes(group.ljust(4, b"\0"), "big"), []
        for _ in range(5):
            value, d = divmod(value, 85)
            digits.append(33 + d)
        out += b"z" if group == bytes(4) else bytes(digits[::-1])[: len(group) + 1]
    return bytes(out) + b"~>"


def run_lengths(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while i + n < len(data) and n < 128 and data[i + n] == data[i]:
            n += 1
        out += bytes([257 - n, data[i]]) if n > 1 else bytes([0, data[i]])
        i += n
    return bytes(out) + b"\x80"


def png_rows(data: bytes, width: int = 12, step: int = 3) -> bytes:
    """Rows in turn by none, left, above, mean and Paeth's guess."""
    out, above = bytearray(), bytes(width)
    for k, i in enumerate(range(0, len(data), width)):
        row, kind = data[i : i + width].ljust(width, b"\0"), k % 5
        out.append(kind)
        for j, x in enumerate(row):
            a, b, c = (row[j - step] if j >= step else 0), above[j], (above[j - step] if j >= step else 0)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((x - (0, a, b, (a + b) // 2, best)[kind]) & 255)
        above = row
    return zlib.compress(bytes(out), 1)


def tiff_rows(data: bytes, width: int = 12, step: int = 3) -> bytes:
    rows = [data[i : i + width].ljust(width, b"\0") for i in range(0, len(data), width)]
    return zlib.compress(b"".join(bytes((x - (r[j - step] if j >= step else 0)) & 255 for j, x in enumerate(r)) for r in rows), 1)


FILTERS: dict[str, tuple[Callable, str, dict]] = {
    "lzw_roundtrip": (lzw_codes, "LZWDecode", {}),
    "ascii85_roundtrip": (ascii85, "ASCII85Decode", {}),
    "ascii_hex_roundtrip": (lambda d: b" ".join(b"%02x" % x for x in d) + b">", "AHx", {}),
    "run_length_roundtrip": (run_lengths, "RL", {}),
    "png_predictors_roundtrip": (png_rows, "FlateDecode", {"Predictor": 15, "Colors": 3, "Columns": 4}),
    "tiff_predictor_roundtrip": (tiff_rows, "Fl", {"Predictor": 2, "Colors": 3, "Columns": 4}),
}


def undone(name: str):
    encode, codec, parms = FILTERS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.encode() for t in b.column("t").to_pylist()]
            back = [decode_chain(encode(t), [codec], [parms])[0][: len(t)] for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(back, pa.binary())], ["part", "data"])

    def of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("part"), F.concat(F.repeat("p_name", 9), F.repeat(F.lit("\0"), 8), "p_type").alias("t"))
        return rows.mapInArrow(run, "part long, data binary").select("part", F.sha2("data", 256).alias("digest"))

    return of_parts


for _name in FILTERS:
    query(_name, "SELECT p_partkey AS part, sha256(repeat(p_name, 9) || repeat(chr(0), 8) || p_type) AS digest FROM part")(undone(_name))


# Files of all structures.


def packed_pdf(pages: int) -> bytes:
    """Catalog, page tree and pages in an object stream, found by a cross-reference stream."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (3 + i) for i in range(pages)) + b"] /Count %d /MediaBox [0 0 90 60] >>" % pages]
    inner += [b"<< /Type /Page /Parent 2 0 R >>"] * pages
    offsets, at = [], 0
    for body in inner:
        offsets.append(at)
        at += len(body) + 1
    head = b" ".join(b"%d %d" % (i + 1, o) for i, o in enumerate(offsets)) + b" "
    data = zlib.compress(head + b" ".join(inner) + b" ")
    container = len(inner) + 1
    out = bytearray(b"%PDF-1.5\n")
    place = len(out)
    out += b"%d 0 obj\n<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (container, len(inner), len(head), len(data)) + data + b"\nendstream\nendobj\n"
    start = len(out)
    rows = struct.pack(">BHB", 0, 0, 255) + b"".join(struct.pack(">BHB", 2, container, i) for i in range(len(inner))) + struct.pack(">BHB", 1, place, 0) + struct.pack(">BHB", 1, start, 0)
    out += b"%d 0 obj\n<< /Type /XRef /W [1 2 1] /Size %d /Root 1 0 R /Length %d >>\nstream\n" % (container + 1, container + 2, len(rows)) + rows + b"\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % start
    return bytes(out)


def structured(kind: int, pages: int) -> bytes:
    plain = build_pdf([b"q Q"] * pages)
    if kind == 0:
        return packed_pdf(pages)
    if kind == 1:  # no table where it is said to be
        return plain[: plain.rfind(b"startxref")] + b"startxref\n7\n%%EOF\n"
    if kind == 2:  # cut off before its table
        return plain[: plain.rfind(b"xref\n0")]
    if kind == 3:
        return plain.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << >>")
    if kind == 4:
        return plain.replace(b"%PDF-", b"%TXT-")
    if kind == 5:  # rubbish before the header
        return b"rubbish\n" + plain
    if kind == 6:  # the catalog anew in a later section
        at, old = len(plain), plain.rfind(b"xref\n0")
        new = b"1 0 obj\n<< /Type /Catalog /Pages 2 0 R /OpenAction << /S /JavaScript >> >>\nendobj\n"
        return plain + new + b"xref\n1 1\n%010d 00000 n \ntrailer\n<< /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF\n" % (at, old, at + len(new))
    return plain if kind == 7 else b""


@query(
    "pdf_structures",
    """SELECT o_orderkey AS doc_id, CASE k WHEN 3 THEN 'EncryptedDocument' WHEN 4 THEN 'NotAPdf' WHEN 8 THEN 'EmptyFile' END AS error_kind,
      CASE WHEN k NOT IN (3, 4, 8) THEN CASE WHEN k = 0 THEN '1.5' ELSE '1.4' END END AS version, CASE WHEN k NOT IN (3, 4, 8) THEN n ELSE -1 END AS n_pages,
      CASE WHEN k NOT IN (3, 4, 8) THEN CASE WHEN k = 6 THEN 'OpenAction' ELSE '' END END AS js_locations FROM (SELECT o_orderkey, o_orderkey % 9 AS k, CAST(o_custkey % 4 + 1 AS INTEGER) AS n FROM orders)""",
)
def pdf_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-reference tables and streams, object streams, later sections, rebuilt tables, and files that are refused."""

    def make(b: pa.RecordBatch) -> Iterator[bytes]:
        return (structured(k, n) for k, n in zip(b.column("k").to_pylist(), b.column("n").to_pylist()))

    key = F.col("o_orderkey")
    rows = dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(key.alias("doc_id"), (key % 9).alias("k"), (F.col("o_custkey") % 4 + 1).alias("n"))
    return T.info(T.Files(rows, T.of_each(make)), ["version", "n_pages", "js_locations", "error_kind"]).select("doc_id", "error_kind", "version", F.coalesce("n_pages", F.lit(-1)).alias("n_pages"), "js_locations")


@query("page_content_parts", "SELECT p_partkey AS doc_id, CAST(3 * (1 + p_size % 3) AS BIGINT) AS ops, CAST((1 + p_size % 3) * 7 AS DOUBLE) AS width FROM part")
def page_content_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of several streams are one: operands may be in one and their operator in the next."""

    def make(b: pa.RecordBatch) -> Iterator[bytes]:
        for size in b.column("p_size").to_pylist():
            n = 1 + size % 3
            stream = lambda body: b"<< /Length %d >>\nstream\n" % len(body) + body + b"\nendstream"
            parts = [stream(b"q 7") if k % 2 == 0 else stream(b"w Q") for k in range(2 * n)]
            yield build_pdf([b""], extra=parts, page_extra=b"/Contents [" + b" ".join(b"%d 0 R" % (5 + k) for k in range(2 * n)) + b"] ")

    rows = dealt(table(spark, sf_dir, "part"), "p_partkey").select(F.col("p_partkey").alias("doc_id"), "p_size")
    ops = T.operators(T.Files(rows, T.of_each(make)), ["op", "nums"])
    return ops.groupBy("doc_id").agg(F.count(F.lit(1)).alias("ops"), F.sum(F.when(F.col("op") == "w", F.get("nums", 0))).alias("width"))


# Image files of pages.


@query("pbm_encode_ink", _PIXELS + " SELECT doc AS doc_id, 'P4' || chr(10) || '200 100' || chr(10) AS header, CAST(11 + 2500 AS BIGINT) AS bytes, CAST(count(*) FILTER (tone < 10 AND 255 - CASE tone WHEN 0 THEN 255 ELSE 127 END < 128) AS BIGINT) AS ink FROM top GROUP BY doc")
def pbm_encode_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bitmaps: a bit for each pixel below the middle."""
    measure = lambda file: (file[:11].decode("ascii"), len(file), int.from_bytes(file[11:]).bit_count())
    return T.page_files(drawings(spark, sf_dir), "pbm", "header string, bytes long, ink long", measure, dpi=72.0)


@query("ppm_encode_colors", "SELECT DISTINCT l_orderkey AS doc_id, 'P6' || chr(10) || '200 100' || chr(10) || '255' || chr(10) AS header, CAST(15 + 60000 AS BIGINT) AS bytes FROM lineitem")
def ppm_encode_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_files(drawings(spark, sf_dir), "ppm", "header string, bytes long", lambda file: (file[:15].decode("ascii"), len(file)), dpi=72.0, mode="rgb")


@query("png_roundtrip", _PIXELS + " SELECT doc AS doc_id, 200 AS width, 100 AS height, CAST(255 * 20000 - 255 * count(*) FILTER (tone = 0) - 127 * count(*) FILTER (tone = 5) AS BIGINT) AS gray_sum FROM top GROUP BY doc")
def png_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files, read back by the predictors of stream filters."""
    from quire.sources.filters import predicted

    def measure(file: bytes) -> tuple[int, int, int]:
        width, height = struct.unpack(">II", file[16:24])
        at = file.index(b"IDAT")
        (n,) = struct.unpack(">I", file[at - 4 : at])
        return width, height, gray_sum(predicted(zlib.decompress(file[at + 4 : at + 4 + n]), 15, columns=width))

    return T.page_files(drawings(spark, sf_dir), "png", "width int, height int, gray_sum long", measure, dpi=72.0)


def gray_sum(data: bytes) -> int:
    return int(np.frombuffer(data, np.uint8).sum(dtype="i8"))


# Images of one sample, drawn over the page.

#: kind -> (entries, data of sample v, the gray that comes out in SQL).
SAMPLES: list[tuple[bytes, Callable[[int], bytes], str]] = [
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray", lambda v: bytes([v]), "v"),
    (b"/BitsPerComponent 4 /ColorSpace /DeviceGray", lambda v: bytes([v % 16 << 4]), "v % 16 * 17"),
    (b"/BitsPerComponent 2 /ColorSpace /DeviceGray", lambda v: bytes([v % 4 << 6]), "v % 4 * 85"),
    (b"/BitsPerComponent 1 /ColorSpace /DeviceGray", lambda v: bytes([v % 2 << 7]), "v % 2 * 255"),
    (b"/BitsPerComponent 16 /ColorSpace /DeviceGray", lambda v: bytes([v, v]), "v"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /Decode [1 0]", lambda v: bytes([v]), "255 - v"),
    (b"/BitsPerComponent 8 /ColorSpace [/Indexed /DeviceGray 255 <" + bytes((k * 7) % 256 for k in range(256)).hex().encode() + b">]", lambda v: bytes([v]), "v * 7 % 256"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceRGB", lambda v: bytes([v] * 3), "v"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceCMYK", lambda v: bytes([v, v, v, 51]), "((255 - v) * 204 + 127) // 255"),
    (b"/BitsPerComponent 8 /ColorSpace [/ICCBased 6 0 R]", lambda v: bytes([v]), "v"),
    (b"/BitsPerComponent 8 /ColorSpace [/Separation /Spot /DeviceGray << /FunctionType 2 /Domain [0 1] /N 1 /C0 [1] /C1 [0] >>]", lambda v: bytes([v]), "255 - v"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /Mask [0 99]", lambda v: bytes([v]), "CASE WHEN v < 100 THEN 255 ELSE v END"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /SMask 7 0 R", lambda v: bytes([v]), "255"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /SMask 8 0 R", lambda v: bytes([v]), "v"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /Mask 9 0 R", lambda v: bytes([v]), "255"),
    (b"/BitsPerComponent 8 /ColorSpace /DeviceGray /Mask 10 0 R", lambda v: bytes([v]), "v"),
    (b"/ImageMask true /BitsPerComponent 1", lambda v: bytes([v % 2 << 7]), "CASE WHEN v % 2 = 0 THEN 0 ELSE 255 END"),
    (b"/ImageMask true /BitsPerComponent 1 /Decode [1 0]", lambda v: bytes([v % 2 << 7]), "CASE WHEN v % 2 = 1 THEN 0 ELSE 255 END"),
]


def stream(entries: bytes, data: bytes) -> bytes:
    return b"<< " + entries + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def one_sample(kind: int, v: int) -> bytes:
    entries, data, _ = SAMPLES[kind]
    image = lambda e, d: stream(b"/Type /XObject /Subtype /Image /Width 1 /Height 1 " + e, d)
    gray, mask = b"/BitsPerComponent 8 /ColorSpace /DeviceGray", b"/ImageMask true /BitsPerComponent 1"
    extra = [image(entries, data(v)), stream(b"/N 1", b""), image(gray, b"\0"), image(gray, b"\xff"), image(mask, b"\x80"), image(mask, b"\0")]
    return build_pdf([b"20 0 0 20 0 0 cm /I Do"], 20, 20, extra, b"/Resources << /XObject << /I 5 0 R >> >> ")


def made(rows: DataFrame, make: Callable[[int, int], bytes]) -> T.Files:
    """A PDF for each row of (doc_id, k, v)."""
    return T.Files(dealt(rows.select("doc_id", "k", "v"), "doc_id"), T.of_each(lambda b: map(make, b.column("k").to_pylist(), b.column("v").to_pylist())))


def samples(spark: SparkSession, sf_dir: str, kinds: int) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(key.alias("doc_id"), (key % kinds).alias("k"), (key * 37 % 256).alias("v"))


def middle() -> Column:
    """The middle pixel of a gray page of 20 x 20."""
    return F.conv(F.hex(F.substring("pixels", 10 * 20 + 11, 1)), 16, 10).cast("int")


@query("image_samples", f"SELECT p_partkey AS doc_id, CAST(CASE p_partkey % {len(SAMPLES)} " + " ".join(f"WHEN {k} THEN {sql}" for k, (*_, sql) in enumerate(SAMPLES)) + " END AS INTEGER) AS gray, true AS has_images FROM (SELECT p_partkey, p_partkey * 37 % 256 AS v FROM part)")
def image_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit depths, Decode, colour spaces, soft, stencil and colour-key masks."""
    shown = T.render(made(samples(spark, sf_dir, len(SAMPLES)), one_sample), dpi=72.0, columns=["pixels", "has_images"])
    return shown.select("doc_id", middle().alias("gray"), "has_images")


@query("inline_images", "SELECT p_partkey AS doc_id, CAST(CASE p_partkey % 3 WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE v % 16 * 17 END AS INTEGER) AS gray, true AS has_images FROM (SELECT p_partkey, p_partkey * 37 % 256 AS v FROM part)")
def inline_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make(k: int, v: int) -> bytes:
        entries, data = [(b"/BPC 8 /CS /G /F /AHx", b"%02x>" % v), (b"/BPC 8 /CS /G /D [1 0] /F /AHx", b"%02x>" % v), (b"/BPC 4 /CS /G /F [/AHx]", b"%x0>" % (v % 16))][k]
        return build_pdf([b"20 0 0 20 0 0 cm BI /W 1 /H 1 " + entries + b" ID " + data + b" EI"], 20, 20)

    shown = T.render(made(samples(spark, sf_dir, 3), make), dpi=72.0, columns=["pixels", "has_images"])
    return shown.select("doc_id", middle().alias("gray"), "has_images")


@query("image_table", "SELECT p_partkey AS doc_id, CAST(5 AS BIGINT) AS obj_num, CAST(1 AS INTEGER) AS width, 'Raw' AS filter, 'Ok' AS status FROM part")
def image_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.images(made(samples(spark, sf_dir, len(SAMPLES)), one_sample), ["obj_num", "width", "filter", "status"])
    return found.where("obj_num = 5").select("doc_id", "obj_num", "width", "filter", "status")


# Marks: strokes, glyphs of Type 3 fonts, text as a clip, states, functions.

# Strokes lie between the pixels' edges, where rounding plays no part. A box whose first side is
# level has no first and no last row, any other only no first row.
MARKS: list[tuple[Callable[[int], bytes], str]] = [
    (lambda v: b"%d w 20.25 50.25 m 120.25 50.25 l S" % (2 * (1 + v % 8)), "101 * (2 * (1 + v % 8) - 1)"),
    (lambda v: b"%d w 50.25 20.25 m 50.25 80.25 l S" % (2 * (1 + v % 8)), "(2 * (1 + v % 8) + 1) * 60"),
    (lambda v: b"%d w 2 J 40.25 50.25 m 100.25 50.25 l S" % (4 + 2 * (v % 8)), "(65 + 2 * (v % 8)) * (3 + 2 * (v % 8))"),
    (lambda v: b"q %d 0 0 1 0 0 cm 4 w 10 50 m 20 50 l S Q" % (1 + v % 8), "(10 * (1 + v % 8) + 1) * 3"),
    (lambda v: b"q 20 20 %d 30 re W n 0 0 200 100 re f Q" % (5 + v % 60), "(5 + v % 60 + 1) * 29"),
    (lambda v: b"q /Hidden gs 20 20 %d 30 re f Q" % (5 + v % 60), "0"),
    (lambda v: b"BT /T3 1 Tf 30 30 Td (%s) Tj ET" % (b"a" * (1 + v % 4)), "(1 + v % 4) * 11 * 9"),
    (lambda v: b"q BT /T3 1 Tf 7 Tr 30 30 Td (a) Tj ET Q 10 10 %d 4 re f" % (5 + v % 60), "99 + (5 + v % 60 + 1) * 3"),
    (lambda v: b"/Fm Do q 1 0 0 1 %d 0 cm /Fm Do Q" % (40 + v % 60), "2 * 21 * 9"),
    (lambda v: b"/P cs /OC /Off BDC 20 20 50 30 re f EMC BX frob EX 10 10 %d 4 re f" % (5 + v % 60), "(51 * 29 + (5 + v % 60 + 1) * 3)"),
]
RESOURCES = (
    b"/Resources << /ExtGState << /Hidden << /ca 0 /CA 0 >> >> /XObject << /Fm 5 0 R >> "
    b"/Font << /T3 << /Type /Font /Subtype /Type3 /FontBBox [0 0 10 10] /FontMatrix [1 0 0 1 0 0] /FirstChar 97 /LastChar 97 /Widths [20] /Encoding << /Differences [97 /box] >> /CharProcs << /box 6 0 R >> >> >> >> "
)


def mark(kind: int, v: int) -> bytes:
    extra = [stream(b"/Type /XObject /Subtype /Form /BBox [0 0 200 100]", b"10 10 20 10 re f"), stream(b"", b"20 0 0 0 10 10 d1 0 0 10 10 re f")]
    return build_pdf([MARKS[kind][0](v)], 200, 100, extra, RESOURCES)


@query("page_marks", f"SELECT p_partkey AS doc_id, CAST(CASE p_partkey % {len(MARKS)} " + " ".join(f"WHEN {k} THEN {sql}" for k, (_, sql) in enumerate(MARKS)) + " END AS BIGINT) AS dark FROM (SELECT p_partkey, p_partkey * 37 % 256 AS v FROM part)")
def page_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes with caps and scaled widths, clips, opacity, Type 3 glyphs, forms, compatibility sections."""
    shown = T.render(made(samples(spark, sf_dir, len(MARKS)), mark), dpi=72.0, pixels=False, columns=["ink_pixels"])
    return shown.select("doc_id", F.col("ink_pixels").alias("dark"))


# Glyphs of a Type 1 font program, which is made here.


def type1_number(n: int) -> bytes:
    return bytes([n + 139]) if -107 <= n <= 107 else bytes([255]) + n.to_bytes(4, "big", signed=True)


@lru_cache(256)
def type1_program(size: int) -> bytes:
    """Glyphs of ``size`` x ``size`` units: a box, one by a subroutine, one of curves and a flex, one put together."""
    from quire.drawing.type1 import CHARSTRING_KEY, EEXEC_KEY, encrypted

    op = lambda *words: b"".join(type1_number(w) if isinstance(w, int) else w for w in words)
    hsbw, hline, vline, hmove, rmove, close, call, back, end = (bytes([b]) for b in (13, 6, 7, 22, 21, 9, 10, 11, 14))
    other, pop, set_point, seac, div = (bytes([12, b]) for b in (16, 17, 33, 6, 12))
    box = op(size, hline, size, vline, -size, hline, close)
    flex = op(size // 2, hmove, 0, 2, other) + op(0, 0, rmove, 0, 2, other) * 2
    glyphs = {
        ".notdef": op(0, 500, hsbw, end),
        "a": op(0, 1000, hsbw, 100, hmove) + box + end,
        "b": op(0, 2000, 2, div, hsbw, 100, hmove, 4, call, end),
        "acute": op(0, 500, hsbw, 0, hmove) + box + end,
        "aacute": op(0, 1000, hsbw, 0, 0, 400, 97, 194, seac),
        "c": op(0, 1000, hsbw, 100, hmove, 0, 1, other) + flex + op(size // 2, hmove, 0, 2, other) + op(0, 0, rmove, 0, 2, other) * 3 + op(50, size + 100, 0, 3, 0, other, pop, pop, set_point, size, vline, -size, hline, close, end),
    }
    rd = lambda code: encrypted(code, CHARSTRING_KEY)
    entry = lambda head, code, tail: head + b" %d RD " % len(rd(code)) + rd(code) + tail
    private = b"dup /Private 8 dict dup begin /lenIV 4 def /Subrs 5 array\n" + entry(b"dup 4", box + back, b" NP\n") + b"ND\n2 index /CharStrings %d dict dup begin\n" % len(glyphs)
    private += b"".join(entry(b"/" + name.encode(), code, b" ND\n") for name, code in glyphs.items()) + b"end end\nmark currentfile closefile\n"
    return b"%!FontType1\n/FontMatrix [0.001 0 0 0.001 0 0] def\n/Encoding 256 array\ndup 97 /a put\nreadonly def\ncurrentfile eexec\n" + encrypted(private, EEXEC_KEY)


@query("type1_glyphs", "SELECT p_partkey AS doc_id, CAST(CASE p_partkey % 4 WHEN 3 THEN 2 ELSE 1 END * (n + 1) * (n - 1) AS BIGINT) AS dark, true AS embedded FROM (SELECT p_partkey, 5 + p_partkey * 37 % 256 % 20 AS n FROM part)")
def type1_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes drawn by lines, by a subroutine, by a flex and by a composed glyph."""

    def make(k: int, v: int) -> bytes:
        font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Boxes /FirstChar 97 /LastChar 100 /Widths [1000 1000 1000 1000] /FontDescriptor 6 0 R /Encoding << /Differences [97 /a /b /c /aacute] >> >>"
        descriptor = b"<< /Type /FontDescriptor /FontName /Boxes /Flags 4 /FontFile 7 0 R >>"
        page = b"BT /F 100 Tf 10.25 20.25 Td (%c) Tj ET" % (97 + k)
        return build_pdf([page], 200, 100, [font, descriptor, stream(b"", type1_program(10 * (5 + v % 20)))], b"/Resources << /Font << /F 5 0 R >> >> ")

    shown = T.drawn_fonts(made(samples(spark, sf_dir, 4), make), dpi=72.0)
    return shown.select("doc_id", F.col("ink_pixels").alias("dark"), "embedded")


@lru_cache(1024)  # all there are; the making, by a slow encoder, is no part of what is shown
def jbig2_page(k: int, v: int) -> bytes:
    from quire.sources.fixtures import jbig2_region

    rows = [[int((x * 3 + y * 5 + v) % 4 == 0) for x in range(20)] for y in range(20)]
    entries = b"/Type /XObject /Subtype /Image /Width 20 /Height 20 /BitsPerComponent 1 /ColorSpace /DeviceGray /Filter /JBIG2Decode"
    return build_pdf([b"20 0 0 20 0 0 cm /I Do"], 20, 20, [stream(entries, jbig2_region(rows, k, like_above=v % 2 == 1))], b"/Resources << /XObject << /I 5 0 R >> >> ")


@query("jbig2_images", "SELECT p_partkey AS doc_id, CAST(count(*) FILTER ((x.k * 3 + y.k * 5 + p_partkey * 37 % 256) % 4 = 0) AS BIGINT) AS dark, true AS has_images FROM part, generate_series(0, 19) x(k), generate_series(0, 19) y(k) GROUP BY p_partkey")
def jbig2_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that are one bilevel image in arithmetic code, in all four templates."""

    shown = T.render(made(samples(spark, sf_dir, 4), jbig2_page), dpi=72.0, pixels=False, columns=["ink_pixels", "has_images"])
    return shown.select("doc_id", F.col("ink_pixels").alias("dark"), "has_images")
