"""PDF bytes in a column -> tables of cross-references, objects, pages, operators and pixels.

Every function takes a DataFrame with ``doc_id`` and ``content`` (binary), or Files, and reads
files inside ``mapInArrow``: one file never leaves its task, and a damaged one gives an error
row, not a failed job. ``columns`` names those that are wanted; others are not sent to Spark.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.drawing import images as I
from quire.drawing.deskew import straightened
from quire.drawing.page import FILTERS, OutOfTime, draw, luma, round_half
from quire.drawing.text import resolve_once
from quire.functions.geometry import DPI_STEPS, MAX_AREA, MAX_SIDE
from quire.sources.pdf import Document, Name, PdfError, Ref, Stream, as_int, content_ops
from quire.sources.sinks import encode_page

PAGES = "page_num int, page_obj long, width_pts double, height_pts double, rotate_cw int, user_unit double, origin_x double, origin_y double, js_locations string, error_kind string"
XREF = "obj_num long, kind string, place long, gen long, section int, error_kind string"
OBJECTS = "obj_num long, kind string, value string, error_kind string"
OPS = "page_num int, op_seq long, op string, nums array<double>, name string, str binary, error_kind string"
RENDERED = "page_num int, width int, height int, pixels binary, channels int, ink_pixels long, gray_sum long, dpi double, skew double, has_images boolean, has_vector_text boolean, dominant_filter string, source_ppi double, suggested_dpi double, unknown_ops string, failed_images string, error_kind string, error_message string"
PRESCAN = "page_num int, n_ops long, has_images boolean, has_vector_text boolean, dominant_filter string, source_ppi double, suggested_dpi double, unknown_ops string, error_kind string"
INFO = "version string, n_pages int, n_objects long, linearized_pages int, encrypted boolean, js_locations string, error_kind string"
TREE = "node long, parent long, ord int, declared int, kind string, error_kind string"
GLYPHS = "page_num int, k long, character string, x double, y double, size double, error_kind string"
IMAGES = "obj_num long, width int, height int, filter string, status string, has_alpha boolean, digest string, error_kind string"
FONTS = "obj_num long, subtype string, base_font string, two_bytes boolean, embedded boolean, n_widths int, error_kind string"
NUMBERS = frozenset((int, float))
#: Bytes of rows that wait for others before they leave a task.
HELD = 16 << 20
MODES = {"gray": 1, "mono": 1, "rgb": 3}


def read_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(doc_id, content) of files; doc_id is the path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("doc_id"), "content")


def named(e: Exception) -> tuple[str, str]:
    """(kind, message) of an error in a file."""
    return (e.kind, e.message) if hasattr(e, "kind") and hasattr(e, "message") else ("BadDocument", f"{type(e).__name__}: {e}"[:200])


def fitting(values: tuple, kind: pa.DataType) -> pa.Array:
    """A column; a value that a damaged file makes too large for its type is null."""
    try:
        return pa.array(values, kind)
    except (pa.ArrowException, ValueError, OverflowError, TypeError):
        out = []
        for v in values:
            try:
                out.append(pa.scalar(v, kind))
            except (pa.ArrowException, ValueError, OverflowError, TypeError):
                out.append(None)
        return pa.array([None if v is None else v.as_py() for v in out], kind)


class Files(NamedTuple):
    """Files that are made where they are read: rows with a ``doc_id``, and what makes (doc_id, content) of batches of them."""

    rows: DataFrame
    make: Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]]


def of_each(make: Callable[[pa.RecordBatch], Iterable[bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterable[tuple]]:
    """For Files of which each is one row: ``make`` gives the contents of a batch, in order."""
    return lambda batches: (pair for b in batches for pair in zip(b.column("doc_id").to_pylist(), make(b)))


def per_document(docs: DataFrame | Files, schema: str, rows: Callable[[Document], Iterator[tuple]], failed: Callable[[str, str], tuple], columns: Sequence[str] | None = None) -> DataFrame:
    """``rows(document)`` for every file, or one row ``failed(kind, message)``; of its columns those named."""
    read, make = docs if isinstance(docs, Files) else (docs.select("doc_id", "content"), of_each(lambda b: (c.as_py() for c in b.column("content"))))
    spark = read.sparkSession
    key = read.schema["doc_id"].dataType.simpleString()
    fields = [f.split() for f in schema.split(", ")]
    places = [i for i, (name, _) in enumerate(fields) if columns is None or name in columns]
    full = ", ".join(f"{name} {kind}" for name, kind in [("doc_id", key), *(fields[i] for i in places)])
    names = ["doc_id", *(fields[i][0] for i in places)]
    long = [i for i in places if fields[i][1] == "binary"]
    parsed = spark.createDataFrame([], full).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(parsed)
        ids, out, held = [], [], 0
        for doc_id, content in make(batches):
            try:
                doc = Document(content or b"")
                if doc.encrypted:
                    raise PdfError("EncryptedDocument", "not opened")
                for row in rows(doc):
                    ids.append(doc_id)
                    out.append(row)
                    for i in long:
                        held += len(row[i] or b"")
                    if len(out) >= 5000 or held >= HELD:
                        yield arrow(ids, out, types)
                        ids, out, held = [], [], 0
            except Exception as e:  # whatever a damaged file leads to, it is a row
                ids.append(doc_id)
                out.append(failed(*named(e)))
        if out:
            yield arrow(ids, out, types)

    def arrow(ids: list, out: list[tuple], types: pa.Schema) -> pa.RecordBatch:
        values = list(zip(*out))
        return pa.RecordBatch.from_arrays([fitting(c, f.type) for c, f in zip([ids, *(values[i] for i in places)], types)], names)

    return read.mapInArrow(run, full)


def pages(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    def rows(doc: Document):
        scripts = ",".join(doc.javascript())
        for n, (num, _, own) in enumerate(doc.pages(), 1):
            g = doc.geometry(own)
            yield (n, num, g["width_pts"], g["height_pts"], g["rotate_cw"], g["user_unit"], g["origin_x"], g["origin_y"], scripts, None)

    return per_document(docs, PAGES, rows, lambda kind, _: (None,) * 9 + (kind,), columns)


def xref(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    def rows(doc: Document):
        for num, (kind, place, gen, section) in sorted(doc.xref.items()):
            yield num, kind, place, gen, section, None

    return per_document(docs, XREF, rows, lambda kind, _: (None,) * 5 + (kind,), columns)


def plain(x):
    """An object as JSON: names with a slash, references as {"R": [num, gen]}."""
    if isinstance(x, Stream):
        return {"stream": len(x.raw), "dict": plain(x.info)}
    if isinstance(x, Ref):
        return {"R": [x.num, x.gen]}
    if isinstance(x, Name):
        return "/" + x
    if isinstance(x, bytes):
        return x.decode("latin-1")
    if isinstance(x, list):
        return [plain(v) for v in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


KINDS = {Stream: "stream", Ref: "reference", Name: "name", bytes: "string", list: "array", dict: "dictionary", bool: "boolean", int: "integer", float: "real"}


def kind_of(x) -> str:
    return KINDS.get(type(x), "null")


def objects(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    """``value`` is JSON, for ``parse_json`` or ``get_json_object``."""
    valued = columns is None or "value" in columns

    def rows(doc: Document):
        for num, (kind, *_) in sorted(doc.xref.items()):
            if kind != "free":
                found = doc.get(Ref(num, 0))
                yield num, kind_of(found), json.dumps(plain(found), sort_keys=True) if valued else None, None

    return per_document(docs, OBJECTS, rows, lambda kind, _: (None,) * 3 + (kind,), columns)


def operators(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    def rows(doc: Document):
        for n, (_, page, _) in enumerate(doc.pages(), 1):
            for k, op in enumerate(content_ops(doc.content(page))):
                if NUMBERS.issuperset(map(type, op.operands)):  # as most are
                    yield n, k, op.keyword, list(map(float, op.operands)), None, None, None
                    continue
                flat = [y for x in op.operands for y in (x if isinstance(x, list) else [x])]
                nums = [float(x) for x in flat if isinstance(x, (int, float)) and not isinstance(x, bool)]
                name = next((str(x) for x in flat if isinstance(x, Name)), None)
                text = b"".join(x for x in flat if isinstance(x, bytes))
                yield n, k, op.keyword, nums, name, text or None, None

    return per_document(docs, OPS, rows, lambda kind, _: (None,) * 6 + (kind,), columns)


def info(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    """One row a file; encrypted files are named as such, not opened."""

    def rows(doc: Document):
        # The key stands in the file as it is, unless it is escaped or packed.
        hidden = b"Linearized" in doc.data or b"#" in doc.data or any(kind == "packed" for kind, *_ in doc.xref.values())
        found = (doc.get(Ref(n, 0)) for n in sorted(doc.xref)) if hidden else ()
        first = next((x for x in found if isinstance(x, dict) and "Linearized" in x), {})
        used = sum(kind != "free" for kind, *_ in doc.xref.values())
        at = doc.data.find(b"%PDF-") + 5  # other bytes may come before
        yield doc.data[at : at + 3].decode("latin-1"), len(doc.pages()), used, as_int(first.get("N")) if first else None, False, ",".join(doc.javascript()), None

    return per_document(docs, INFO, rows, lambda kind, _: (None,) * 4 + (kind == "EncryptedDocument", None, kind), columns)


def page_tree(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    """Nodes of the page tree with their parents and places, for recursion by joins."""

    def rows(doc: Document):
        root = doc.get(doc.trailer.get("Root"))
        stack, seen = [(root.get("Pages") if isinstance(root, dict) else None, None, 0)], set()
        while stack:
            ref, parent, ord_ = stack.pop()
            node = doc.get(ref)
            if not isinstance(node, dict) or not isinstance(ref, Ref) or ref.num in seen:
                continue
            seen.add(ref.num)
            kids = doc.get(node.get("Kids"))
            leaf = not isinstance(kids, list) or node.get("Type") == "Page"
            yield ref.num, parent, ord_, None if leaf else as_int(doc.get(node.get("Count"))), "page" if leaf else "node", None
            stack += [] if leaf else [(k, ref.num, i) for i, k in enumerate(kids)]

    return per_document(docs, TREE, rows, lambda kind, _: (None,) * 5 + (kind,), columns)


def suggested(ppi: float | None) -> float | None:
    """The first resolution that is at least the images'."""
    return None if not ppi else float(next((s for s in DPI_STEPS if s >= ppi), DPI_STEPS[-1]))


def prescan(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    """What pages hold, found without drawing them."""

    def rows(doc: Document):
        for n, (_, page, own) in enumerate(doc.pages(), 1):
            p = draw(doc, page, own, doc.geometry(own), 72.0, paints=False)
            s, ppi = p.seen, p.seen.max_ppi * 72 or None
            yield n, sum(1 for _ in content_ops(doc.content(page))), s.has_images, s.has_vector_text, s.dominant(), ppi, suggested(ppi), ",".join(sorted(p.unknown)), None

    return per_document(docs, PRESCAN, rows, lambda kind, _: (None,) * 8 + (kind,), columns)


def glyphs(docs: DataFrame | Files, dpi: float = 72.0, columns: Sequence[str] | None = None) -> DataFrame:
    """Shown characters in order, with their pens in pixels (y from the top)."""

    def rows(doc: Document):
        for n, (_, page, own) in enumerate(doc.pages(), 1):
            for k, (c, x, y, size) in enumerate(draw(doc, page, own, doc.geometry(own), dpi, paints=False).glyphs):
                yield n, k, c, x, y, size, None

    return per_document(docs, GLYPHS, rows, lambda kind, _: (None,) * 6 + (kind,), columns)


def images(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    """Image objects with the outcome of decoding each; the digest is of the decoded pixels."""

    def rows(doc: Document):
        for num, (kind, *_) in sorted(doc.xref.items()):
            found = doc.get(Ref(num, 0)) if kind != "free" else None
            if not isinstance(found, Stream) or found.info.get("Subtype") != "Image":
                continue
            w, h, name = as_int(doc.get(found.info.get("Width"))), as_int(doc.get(found.info.get("Height"))), I.name_of_filter(doc, found.info, FILTERS)
            try:
                image = I.resolve(doc, found)
                data = image.rgb if image.rgb is not None else image.alpha
                yield num, w, h, name, "Ok", image.alpha is not None, hashlib.sha256(data.tobytes()).hexdigest(), None
            except I.ImageError as e:
                yield num, w, h, name, e.kind, None, None, None

    return per_document(docs, IMAGES, rows, lambda kind, _: (None,) * 7 + (kind,), columns)


def fonts(docs: DataFrame | Files, columns: Sequence[str] | None = None) -> DataFrame:
    return per_document(docs, FONTS, font_rows, lambda kind, _: (None,) * 6 + (kind,), columns)


def font_rows(doc: Document) -> Iterator[tuple]:
    for num, (kind, *_) in sorted(doc.xref.items()):
        found = doc.get(Ref(num, 0)) if kind != "free" else None
        if isinstance(found, dict) and found.get("Type") == "Font" and not str(found.get("Subtype")).startswith("CIDFont"):
            font = resolve_once(doc, found)
            yield num, str(found.get("Subtype")), str(doc.get(found.get("BaseFont")) or "") or None, font.two_bytes, font.embedded, len(font.widths), None


def page_row(doc: Document, n: int, page: dict, own: dict, dpi: float, mode: str, antialias: bool, deskew: bool, annotations: bool, seconds: float | None = None, keep: bool = True) -> tuple:
    """A row of RENDERED, without pixels unless ``keep``; ``seconds`` is the time that drawing may take."""
    try:
        g = doc.geometry(own)
    except Exception as e:
        return n, *(None,) * 15, *named(e)
    if not (math.isfinite(g["width_pts"]) and math.isfinite(g["height_pts"])):
        return n, *(None,) * 15, "PageDegenerate", "no finite size"
    w, h = round_half(g["width_pts"] * dpi / 72), round_half(g["height_pts"] * dpi / 72)
    failed = lambda kind, message: (n, *(x if x < 1 << 31 else None for x in (w, h)), *(None,) * 4, dpi, *(None,) * 8, kind, message)
    error = "PageDegenerate" if w <= 0 or h <= 0 else "PageTooLarge" if max(w, h) > MAX_SIDE else "PageAreaTooLarge" if w * h > MAX_AREA else None
    if error:
        return failed(error, f"{w} x {h} pixels")
    try:
        p = draw(doc, page, own, g, dpi, antialias, annotations, seconds=seconds)
    except OutOfTime:
        return failed("PageTimeout", f"over {seconds} seconds")
    except Exception as e:  # one page does not stop the others
        return failed("RenderFailed", f"{type(e).__name__}: {e}"[:200])
    skew, s, gray = None, p.seen, luma(p.pixels) if p.colored else p.pixels[..., 0].copy()  # of a gray its luma is itself
    if deskew:
        gray, skew = straightened(gray)
    ink = gray < 128
    total = gray.sum(dtype="u4" if gray.size < 1 << 24 else "i8")
    pixels = p.pixels if mode == "rgb" or not keep else gray if mode == "gray" else np.where(ink, 0, 255).astype(np.uint8)
    ppi = s.max_ppi * dpi or None
    return n, w, h, pixels.tobytes() if keep else None, MODES[mode], int(np.count_nonzero(ink)), int(total), dpi, skew, s.has_images, s.has_vector_text, s.dominant(), ppi, suggested(ppi), ",".join(sorted(p.unknown)), ",".join(s.failed), None, None


def check_options(dpi: float, first: int, last: int | None, parity: str | None, mode: str, deskew: bool) -> None:
    if not (0 < dpi < float("inf")) or first < 1 or last is not None and last < first:
        raise ValueError(f"dpi {dpi}, pages {first} to {last}")
    if mode not in MODES or parity not in (None, "odd", "even"):
        raise ValueError(f"mode {mode!r}, parity {parity!r}")
    if deskew and mode == "rgb":
        raise ValueError("deskew needs gray or mono pages")


def render(docs: DataFrame | Files, dpi: float = 150.0, first: int = 1, last: int | None = None, parity: str | None = None, mode: str = "gray", antialias: bool = False, deskew: bool = False, annotations: bool = True, seconds: float | None = None, pixels: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Pages of a range as ``gray``, ``mono`` (0 or 255) or ``rgb`` bytes, with the number of pixels darker
    than the middle and the sum of all grays. A page that can't be drawn, or not within ``seconds``,
    has an error and no pixels. ``pixels`` false leaves them out, where their measures are enough."""
    check_options(dpi, first, last, parity, mode, deskew)
    rows = drawn(lambda n: n >= first and (last is None or n <= last) and (parity is None or n % 2 == (parity == "odd")), (dpi, mode, antialias, deskew, annotations, seconds, pixels))
    return per_document(docs, RENDERED, rows, lambda kind, message: (None,) * 16 + (kind, message), columns)


def drawn(wanted: Callable[[int], bool], options: tuple) -> Callable[[Document], Iterator[tuple]]:
    """Rows of RENDERED."""

    def rows(doc: Document):
        found = doc.pages()
        if not found:
            raise PdfError("NoPages", "no page in the tree")
        for n, (_, page, own) in enumerate(found, 1):
            if wanted(n):
                yield page_row(doc, n, page, own, *options)

    return rows


def drawn_fonts(docs: DataFrame | Files, dpi: float = 150.0) -> DataFrame:
    """(ink_pixels, embedded) of each page with each font of its document, which is read once for both."""
    at = [f.split()[0] for f in RENDERED.split(", ")].index("ink_pixels")
    pages_of = drawn(lambda n: True, (dpi, "gray", False, False, True, None, False))

    def rows(doc: Document):
        found = list(font_rows(doc))
        for page in pages_of(doc) if found else ():
            yield from ((page[at], font[4]) for font in found)

    return per_document(docs, "ink_pixels long, embedded boolean", rows, lambda *_: (None, None))


def page_files(docs: DataFrame | Files, kind: str, measured: str, measure: Callable[[bytes], tuple], dpi: float = 150.0, mode: str = "gray") -> DataFrame:
    """``measure(file)`` for the image file of every page, in columns ``measured``. Files stay in the task that
    draws their pages; one that can't be drawn gives nulls."""
    check_options(dpi, 1, None, None, mode, False)
    at = [f.split()[0] for f in RENDERED.split(", ")].index("pixels")
    pages_of = drawn(lambda n: True, (dpi, mode, False, False, True, None, True))
    nothing = (None,) * len(measured.split(", "))

    def rows(doc: Document):
        for row in pages_of(doc):
            _, width, height, pixels, channels = row[: at + 2]
            yield nothing if pixels is None else measure(encode_page(pixels, width, height, channels, kind))

    return per_document(docs, measured, rows, lambda *_: nothing)
