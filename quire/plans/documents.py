"""Queries of the PDF operators over documents that are made inside the plan."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.registry import query, table
from quire.sources import pdf_tables as T
from quire.sources.fixtures import build_pdf

#: Lineitem as rectangles: corners, size and gray of each, in painting order.
RECTS = """SELECT l_orderkey AS doc, l_partkey % 160 AS x, l_suppkey % 70 AS y, 2 + CAST(l_quantity AS BIGINT) % 30 AS w, 2 + l_linenumber * 3 AS h,
 CASE WHEN l_returnflag = 'A' THEN 0 WHEN l_returnflag = 'N' THEN 5 ELSE 10 END AS tone FROM lineitem"""


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Over all tasks, however few bytes there are: drawing takes far longer than reading."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def drawings(spark: SparkSession, sf_dir: str) -> T.Files:
    """A PDF per order, whose page shows its lineitems."""
    rects = dealt(spark.sql(RECTS.replace("FROM lineitem", "FROM {lines}"), lines=table(spark, sf_dir, "lineitem")), "doc")
    return T.Files(rects.withColumnRenamed("doc", "doc_id").sortWithinPartitions("doc_id", "tone", "x", "y", "w", "h"), marked)


def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(doc_id, content) of sorted rectangles, equal ones once: documents may go on in the next batch."""
    first, doc, last, lines = True, None, None, []
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("doc_id", "tone", "x", "y", "w", "h")]):
            if row == last:
                continue
            if row[0] != doc or first:
                if not first:
                    yield doc, build_pdf(["".join(lines).encode()])
                first, doc, lines = False, row[0], []
            last = row
            if None in row:  # what is null is left out
                lines.append(" ".join([f"{row[1] / 10:.1f} g", *(str(v) for v in row[2:] if v is not None), "re f\n"]))
            else:
                lines.append("%.1f g %d %d %d %d re f\n" % (row[1] / 10, *row[2:]))
    if not first:
        yield doc, build_pdf(["".join(lines).encode()])


@query("pdf_roundtrip_pages", "SELECT DISTINCT l_orderkey AS doc_id, 1 AS page_num, CAST(3 AS BIGINT) AS page_obj, 200.0::DOUBLE AS width_pts, 100.0::DOUBLE AS height_pts, 0 AS rotate_cw FROM lineitem")
def pdf_roundtrip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pages(drawings(spark, sf_dir), ["page_num", "page_obj", "width_pts", "height_pts", "rotate_cw"])


@query("pdf_xref", "SELECT doc AS doc_id, CAST(count(*) AS BIGINT) AS in_use FROM (SELECT DISTINCT l_orderkey AS doc, unnest([1, 2, 3, 4]) AS o FROM lineitem) GROUP BY doc")
def pdf_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.xref(drawings(spark, sf_dir), ["kind"]).where("kind = 'direct'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("in_use"))


@query("pdf_objects", "SELECT doc AS doc_id, o AS obj_num, CASE WHEN o = 4 THEN 'stream' ELSE 'dictionary' END AS kind FROM (SELECT DISTINCT l_orderkey AS doc, unnest([1, 2, 3, 4])::BIGINT AS o FROM lineitem)")
def pdf_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.objects(drawings(spark, sf_dir), ["obj_num", "kind"])


@query("ops_decode", f"WITH r AS (SELECT DISTINCT * FROM ({RECTS})) SELECT doc AS doc_id, CAST(count(*) AS BIGINT) AS rectangles, CAST(sum(w * h) AS BIGINT) AS area, CAST(count(*) * 3 AS BIGINT) AS ops FROM r GROUP BY doc")
def ops_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = T.operators(drawings(spark, sf_dir), ["op", "nums"])
    area = F.when(F.col("op") == "re", F.get("nums", 2) * F.get("nums", 3))
    return ops.groupBy("doc_id").agg(F.count_if(F.col("op") == "re").alias("rectangles"), F.sum(area).cast("long").alias("area"), F.count(F.lit(1)).alias("ops"))


# Rows strictly between a rectangle's edges are painted, and its columns with both ends. The last paint wins.
_PIXELS = f"""WITH r AS (SELECT DISTINCT * FROM ({RECTS})),
 p AS (SELECT doc, tone, px, unnest(range(100 - y - h + 1, 100 - y)) AS py, x, y, w, h FROM (SELECT *, unnest(range(x, x + w + 1)) AS px FROM r)),
 top AS (SELECT doc, px, py, arg_max(tone, struct_pack(tone := tone, x := x, y := y, w := w, h := h)) AS tone FROM p GROUP BY ALL)"""


@query("pdf_fill_dark_pixels", _PIXELS + " SELECT doc AS doc_id, 1 AS page_num, 200 AS width, 100 AS height, CAST(count(*) FILTER (tone = 0) AS BIGINT) AS dark, CAST(255 * 20000 - 255 * count(*) FILTER (tone = 0) - 127 * count(*) FILTER (tone = 5) AS BIGINT) AS gray_sum, false AS has_images, false AS has_vector_text FROM top GROUP BY doc")
def pdf_fill_dark_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered pages: how many pixels are ink, and what the pages hold."""
    shown = T.render(drawings(spark, sf_dir), dpi=72.0, pixels=False, columns=["page_num", "width", "height", "ink_pixels", "gray_sum", "has_images", "has_vector_text"])
    return shown.select("doc_id", "page_num", "width", "height", F.col("ink_pixels").alias("dark"), "gray_sum", "has_images", "has_vector_text")


@query("ppm_encode_bytes", "SELECT DISTINCT l_orderkey AS doc_id, CAST(15 + 20000 AS BIGINT) AS pgm_bytes, 'P5' || chr(10) || '200 100' || chr(10) || '255' || chr(10) AS header FROM lineitem")
def ppm_encode_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.page_files(drawings(spark, sf_dir), "pgm", "pgm_bytes long, header string", lambda file: (len(file), file[:15].decode("ascii")), dpi=72.0)


def built(rows: DataFrame, contents: str, extra: bytes = b"") -> T.Files:
    """A PDF for each row, a page for each string of the array ``contents``."""
    make = lambda b: (build_pdf([t.encode("latin-1") for t in texts], page_extra=extra) for texts in b.column("texts").to_pylist())
    return T.Files(dealt(rows.select("doc_id", F.col(contents).alias("texts")), "doc_id"), T.of_each(make))


def texts_of_parts(spark: SparkSession, sf_dir: str) -> T.Files:
    """A page per part that shows its name and then its type."""
    rows = table(spark, sf_dir, "part")
    page = F.concat(F.lit("BT /F 8 Tf 5 50 Td ("), "p_name", F.lit(") Tj 0 -10 Td [("), "p_type", F.lit(")] TJ ET"))
    font = b"/Resources << /Font << /F << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding /FirstChar 0 /Widths [" + b"500 " * 256 + b"] >> >> >> "
    return built(rows.select(F.col("p_partkey").alias("doc_id"), F.array(page).alias("pages")), "pages", font)


@query("pdf_text_extract", "SELECT p_partkey AS doc_id, p_name || p_type AS text, length(p_name || p_type) AS n FROM part")
def pdf_text_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = T.glyphs(texts_of_parts(spark, sf_dir), columns=["k", "character"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "character"))), lambda g: g["character"]), "")
    return shown.groupBy("doc_id").agg(text.alias("text"), F.count(F.lit(1)).alias("n"))


@query("pdf_text_pens", "SELECT p_partkey AS doc_id, CAST(i - 1 AS BIGINT) AS k, 5 + (i - 1) * 4.0::DOUBLE AS x, 50.0::DOUBLE AS y FROM part, LATERAL (SELECT unnest(range(1, length(p_name) + 1)) AS i)")
def pdf_text_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.glyphs(texts_of_parts(spark, sf_dir), columns=["k", "x", "y"]).where("y = 50").select("doc_id", "k", F.round("x", 6).alias("x"), "y")


@query("pdf_prescan", "SELECT p_partkey AS doc_id, 1 AS page_num, CAST(7 AS BIGINT) AS n_ops, false AS has_images, true AS has_vector_text, '' AS unknown_ops FROM part")
def pdf_prescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.prescan(texts_of_parts(spark, sf_dir), ["page_num", "n_ops", "has_images", "has_vector_text", "unknown_ops"])


@query("pdf_info", "SELECT o_orderkey AS doc_id, '1.4' AS version, CAST(o_custkey % 3 + 1 AS INTEGER) AS n_pages, CAST(2 + 2 * (o_custkey % 3 + 1) AS BIGINT) AS n_objects, false AS encrypted FROM orders")
def pdf_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.array_repeat(F.lit("q Q"), (F.col("o_custkey") % 3 + 1).cast("int")).alias("pages"))
    return T.info(built(rows, "pages"), ["version", "n_pages", "n_objects", "encrypted"])


@query("pdf_page_tree", "SELECT o_orderkey AS doc_id, CAST(2 AS BIGINT) AS root, CAST(o_custkey % 3 + 1 AS BIGINT) AS leaves, CAST(o_custkey % 3 + 1 AS INTEGER) AS declared FROM orders")
def pdf_page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), F.array_repeat(F.lit(""), (F.col("o_custkey") % 3 + 1).cast("int")).alias("pages"))
    tree = T.page_tree(built(rows, "pages"), ["node", "declared", "kind"])
    return tree.groupBy("doc_id").agg(F.min(F.when(F.col("kind") == "node", F.col("node"))).alias("root"), F.count_if(F.col("kind") == "page").alias("leaves"), F.max("declared").alias("declared"))


@query(
    "pdf_rendered_colors",
    "SELECT p_partkey AS doc_id, CAST(floor((p_partkey % 11) / 10.0::DOUBLE * 255 + 0.5) AS INTEGER) AS r, CAST(floor((p_partkey % 7) / 10.0::DOUBLE * 255 + 0.5) AS INTEGER) AS g, CAST(floor((p_partkey % 5) / 10.0::DOUBLE * 255 + 0.5) AS INTEGER) AS b FROM part",
)
def pdf_rendered_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle pixel of pages filled with a colour, drawn as RGB."""
    k = F.col("p_partkey")
    tenth = lambda m: F.format_string("%.1f", (k % m) / F.lit(10.0))
    page = F.concat_ws(" ", tenth(11), tenth(7), tenth(5), F.lit("rg 0 0 200 100 re f"))
    rows = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.array(page).alias("pages"))
    at = 15 + 3 * (50 * 200 + 100)
    return T.page_files(built(rows, "pages"), "ppm", "r int, g int, b int", lambda file: tuple(file[at : at + 3]), dpi=72.0, mode="rgb")


@query("letter_pages", "SELECT s_suppkey AS doc_id, 1275 AS width, 1650 AS height, CAST((1 + s_suppkey % 60) * 76 * 74 AS BIGINT) AS dark, true AS has_vector_text FROM supplier")
def letter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter pages at 150 dpi: squares of half an inch, and text without ink."""

    def build(b: pa.RecordBatch) -> Iterator[bytes]:
        for n in b.column("n").to_pylist():
            squares = b"".join(b"%d %d 36 36 re f\n" % (36 + 72 * (i % 6), 36 + 72 * (i // 6)) for i in range(n))
            yield build_pdf([squares + b"BT 3 Tr /F 9 Tf 40 700 Td (words) Tj ET"], 612, 792)

    rows = dealt(table(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("doc_id"), (F.col("s_suppkey") % 60 + 1).alias("n"))
    shown = T.render(T.Files(rows, T.of_each(build)), dpi=150.0, pixels=False)
    return shown.select("doc_id", "width", "height", F.col("ink_pixels").alias("dark"), "has_vector_text")
