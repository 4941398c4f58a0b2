"""Queries of fonts, resources, page geometry, names and stream filters."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import blend as B
from quire.functions import geometry as G
from quire.functions import names as N
from quire.functions.color import long
from quire.operators import text as X
from quire.plans.pixels import PX, d255, pixels
from quire.plans.registry import query, table


@query(
    "code_cid_gid_chain",
    "WITH c AS (SELECT DISTINCT l_partkey % 256 AS code FROM lineitem), m AS (SELECT p_partkey AS code, p_partkey * 3 % 100 AS cid FROM part WHERE p_size % 3 <> 0), g AS (SELECT p_partkey AS cid, p_size * 2 AS gid FROM part) SELECT code, coalesce(m.cid, 0) AS cid, coalesce(gid, 0) AS gid FROM c LEFT JOIN m USING (code) LEFT JOIN g ON g.cid = coalesce(m.cid, 0)",
)
def code_cid_gid_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    codes = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 256).alias("code")).distinct()
    to_cid = part.where("p_size % 3 <> 0").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") * 3 % 100).alias("cid"))
    to_gid = part.select(F.col("p_partkey").alias("cid"), (F.col("p_size") * 2).alias("gid"))
    return X.glyph_ids(codes, to_cid, to_gid).select("code", "cid", "gid")


@query(
    "code_width_lookup",
    "SELECT DISTINCT l_partkey % 200 AS code, l_linenumber AS font, CASE WHEN l_linenumber = 7 THEN -1 WHEN l_partkey % 200 >= 32 AND l_partkey % 200 < 32 + 60 THEN (l_partkey % 200 - 32) * 10 + l_linenumber ELSE 250 END AS width FROM lineitem",
)
def code_width_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 200).alias("code"), F.col("l_linenumber").alias("font")).distinct()
    widths = F.when(F.col("font") != 7, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long")), lambda i: i * 10 + F.col("font")))
    return rows.select("code", "font", F.coalesce(X.code_width(F.col("code"), F.lit(32), widths, long(250)), long(-1)).alias("width"))


@query(
    "glyph_name_differences",
    "WITH c AS (SELECT DISTINCT l_linenumber AS font, l_partkey % 128 AS code FROM lineitem), b AS (SELECT p_partkey AS code, 'base' || p_size AS base_name FROM part WHERE p_partkey BETWEEN 32 AND 126), d AS (SELECT DISTINCT CAST(1 + p_partkey % 7 AS INTEGER) AS font, p_partkey % 128 AS code, 'diff' || (p_partkey % 128) AS name FROM part WHERE p_size < 10) SELECT font, code, coalesce(name, base_name) AS name FROM c LEFT JOIN d USING (font, code) LEFT JOIN b USING (code)",
)
def glyph_name_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    codes = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("font"), (F.col("l_partkey") % 128).alias("code")).distinct()
    base = part.where("p_partkey BETWEEN 32 AND 126").select(F.col("p_partkey").alias("code"), F.concat(F.lit("base"), F.col("p_size").cast("string")).alias("base_name"))
    code = F.col("p_partkey") % 128
    changes = part.where("p_size < 10").select((1 + F.col("p_partkey") % 7).cast("int").alias("font"), code.alias("code"), F.concat(F.lit("diff"), code.cast("string")).alias("name")).distinct()
    return X.encoded_names(codes, base, changes).select("font", "code", "name")


@query(
    "cmap_ranges",
    "WITH r AS (SELECT p_partkey AS map, p_partkey * 7 % 500 AS lo, p_partkey * 7 % 500 + p_size - 5 AS hi, p_size * 3 AS first FROM part) SELECT map, lo + i AS code, first + i AS cid FROM r, LATERAL (SELECT unnest(range(0, CAST(hi - lo + 1 AS BIGINT))) AS i) WHERE hi >= lo",
)
def cmap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = table(spark, sf_dir, "part").selectExpr("p_partkey AS map", "p_partkey * 7 % 500 AS lo", "p_partkey * 7 % 500 + p_size - 5 AS hi", "CAST(p_size * 3 AS BIGINT) AS first")
    return X.expanded_ranges(ranges, "map")


@query(
    "show_text_pens",
    "WITH s AS (SELECT p_partkey AS str, p_name AS t FROM part), c AS (SELECT str, CAST(i - 1 AS INTEGER) AS k, CAST(ord(substr(t, CAST(i AS BIGINT), 1)) AS BIGINT) AS code FROM s, LATERAL (SELECT unnest(range(1, length(t) + 1)) AS i)), w AS (SELECT p_partkey AS code, CAST(max(p_size) * 10 AS BIGINT) AS width FROM part GROUP BY 1) SELECT str, k, code, CAST(coalesce(sum(coalesce(width, 500) * 12 + 2000 + CASE WHEN code = 32 THEN 3000 ELSE 0 END) OVER (PARTITION BY str ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pen FROM c LEFT JOIN w USING (code)",
)
def show_text_pens(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    codes = X.shown_codes(part.select(F.col("p_partkey").alias("str"), "p_name"), ["str"], "p_name")
    widths = part.groupBy(F.col("p_partkey").alias("code")).agg((F.max("p_size") * 10).cast("long").alias("width"))
    with_width = codes.join(widths, "code", "left").withColumn("width", F.coalesce("width", long(500)))
    return X.pens(with_width, ["str"], "k", F.lit(12), F.lit(2), F.lit(3), F.lit(1)).select("str", "k", "code", F.col("pen").cast("long").alias("pen"))


@query(
    "annotation_appearance",
    "WITH a AS (SELECT o_custkey AS doc, o_orderkey AS annot, o_orderstatus AS state FROM orders), p AS (SELECT o_custkey AS doc, o_orderkey AS annot, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE s END AS state, o_orderkey * 10 + CASE s WHEN 'F' THEN 1 ELSE 2 END AS stream FROM orders, (VALUES ('F'), ('O')) v(s) WHERE o_orderkey % 4 <> 0 OR s = 'F') SELECT a.doc, a.annot, a.state, coalesce(max(stream), -1) AS stream FROM a LEFT JOIN p ON p.doc = a.doc AND p.annot = a.annot AND (p.state IS NULL OR p.state = a.state) GROUP BY ALL",
)
def annotation_appearance(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    annotations = orders.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("annot"), F.col("o_orderstatus").alias("state"))
    states = orders.withColumn("s", F.explode(F.array(F.lit("F"), F.lit("O")))).where("o_orderkey % 4 <> 0 OR s = 'F'")
    state = F.when(F.col("o_orderkey") % 4 != 0, F.col("s"))
    streams = states.select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("annot"), state.alias("state"), (F.col("o_orderkey") * 10 + F.when(F.col("s") == "F", 1).otherwise(2)).alias("stream"))
    return X.appearance_streams(annotations, streams).withColumn("stream", F.coalesce("stream", F.lit(-1)))


@query(
    "resource_inheritance",
    "WITH u AS (SELECT DISTINCT l_partkey AS form, l_suppkey AS parent, l_linenumber AS name FROM lineitem), o AS (SELECT p_partkey AS form, CAST(p_size % 7 + 1 AS INTEGER) AS name, 'own' || p_partkey AS res FROM part), a AS (SELECT s_suppkey AS parent, CAST(s_nationkey % 7 + 1 AS INTEGER) AS name, 'above' || s_suppkey AS res FROM supplier) SELECT form, parent, name, coalesce(o.res, a.res) AS res FROM u LEFT JOIN o USING (form, name) LEFT JOIN a USING (parent, name)",
)
def resource_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("form"), F.col("l_suppkey").alias("parent"), F.col("l_linenumber").alias("name")).distinct()
    own = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("form"), (F.col("p_size") % 7 + 1).cast("int").alias("name"), F.concat(F.lit("own"), F.col("p_partkey").cast("string")).alias("res"))
    above = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("parent"), (F.col("s_nationkey") % 7 + 1).cast("int").alias("name"), F.concat(F.lit("above"), F.col("s_suppkey").cast("string")).alias("res"))
    return X.inherited_resources(uses, own, above).select("form", "parent", "name", "res")


_BOXES = "b AS (SELECT o_orderkey AS doc, CAST(o_custkey % 50 AS DOUBLE) AS mx, CAST(o_custkey % 30 AS DOUBLE) AS my, CAST(o_custkey % 50 + 200 AS DOUBLE) AS mw, CAST(o_custkey % 30 + 300 AS DOUBLE) AS mh, CAST(o_orderkey % 90 AS DOUBLE) AS cx, CAST(o_orderkey % 70 AS DOUBLE) AS cy, CAST(o_orderkey % 90 + o_custkey % 400 AS DOUBLE) AS cw, CAST(o_orderkey % 70 + o_custkey % 500 AS DOUBLE) AS ch, (o_orderkey % 9 - 4) * 45 AS rotate, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE (o_orderkey % 30) / 2.0::DOUBLE END AS unit FROM orders)"


@query(
    "page_geometry",
    f"""WITH {_BOXES}, i AS (SELECT *, greatest(mx, cx) AS x0, greatest(my, cy) AS y0, least(mw, cw) AS x1, least(mh, ch) AS y1 FROM b),
    f AS (SELECT doc, CASE WHEN x0 < x1 AND y0 < y1 THEN x0 ELSE mx END AS x0, CASE WHEN x0 < x1 AND y0 < y1 THEN y0 ELSE my END AS y0, CASE WHEN x0 < x1 AND y0 < y1 THEN x1 ELSE mw END AS x1, CASE WHEN x0 < x1 AND y0 < y1 THEN y1 ELSE mh END AS y1,
      CASE WHEN (rotate % 360 + 360) % 360 IN (90, 180, 270) THEN (rotate % 360 + 360) % 360 ELSE 0 END AS rotate_cw, least(greatest(coalesce(unit, 1.0), 0.1), 10.0)::DOUBLE AS user_unit FROM i)
    SELECT doc, CASE WHEN rotate_cw IN (90, 270) THEN (y1 - y0) * user_unit ELSE (x1 - x0) * user_unit END AS width_pts, CASE WHEN rotate_cw IN (90, 270) THEN (x1 - x0) * user_unit ELSE (y1 - y0) * user_unit END AS height_pts, CAST(rotate_cw AS BIGINT) AS rotate_cw, user_unit, x0 AS origin_x, y0 AS origin_y FROM f""",
)
def page_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda x: x.cast("double")
    media = [d(c % 50), d(c % 30), d(c % 50 + 200), d(c % 30 + 300)]
    crop = [d(o % 90), d(o % 70), d(o % 90 + c % 400), d(o % 70 + c % 500)]
    found = G.page_geometry(media, crop, (o % 9 - 4) * 45, F.when(o % 5 != 0, (o % 30) / F.lit(2.0)))
    return table(spark, sf_dir, "orders").select(o.alias("doc"), *[v.alias(k) for k, v in found.items()]).withColumn("rotate_cw", F.col("rotate_cw").cast("long"))


@query(
    "initial_matrix",
    """WITH p AS (SELECT DISTINCT o_custkey % 4 * 90 AS turn, CAST(o_custkey % 11 AS DOUBLE) AS x, CAST(o_custkey % 13 AS DOUBLE) AS y, CAST(200 + o_custkey % 17 AS DOUBLE) AS w, CAST(100 + o_custkey % 19 AS DOUBLE) AS h FROM orders)
    SELECT turn, x, y, w, h, CASE turn WHEN 0 THEN 2.0 WHEN 180 THEN -2.0 ELSE 0.0 END::DOUBLE AS a, CASE turn WHEN 90 THEN 2.0 WHEN 270 THEN -2.0 ELSE 0.0 END::DOUBLE AS b, CASE turn WHEN 0 THEN -x * 2 WHEN 90 THEN -y * 2 WHEN 180 THEN (x + w) * 2 ELSE (y + h) * 2 END + 0.0 AS e, CASE turn WHEN 0 THEN (y + h) * 2 WHEN 90 THEN -x * 2 WHEN 180 THEN -y * 2 ELSE (x + w) * 2 END + 0.0 AS f FROM p""",
)
def initial_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    d = lambda x: x.cast("double")
    rows = table(spark, sf_dir, "orders").select((c % 4 * 90).alias("turn"), d(c % 11).alias("x"), d(c % 13).alias("y"), d(200 + c % 17).alias("w"), d(100 + c % 19).alias("h")).distinct()
    m = G.initial_matrix(F.col("w"), F.col("h"), F.col("turn"), F.lit(2.0), F.col("x"), F.col("y"))
    return rows.select("turn", "x", "y", "w", "h", *[(m[i] + 0.0).alias(n) for i, n in ((0, "a"), (1, "b"), (4, "e"), (5, "f"))])


@query("dpi_scales", "SELECT o_orderkey AS doc, round(sqrt(coalesce(CASE WHEN o_orderkey % 3 > 0 THEN (o_custkey % 600 + 1)::DOUBLE END, 150) / 72 * (coalesce(CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 600 + 1)::DOUBLE END, 150) / 72)), 9) AS scale FROM orders")
def dpi_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    scale = G.combined_scale(F.when(o % 3 > 0, (c % 600 + 1).cast("double")), F.when(o % 5 > 0, (o % 600 + 1).cast("double")))
    return table(spark, sf_dir, "orders").select(o.alias("doc"), F.round(scale, 9).alias("scale"))


_R = f"least(s + {d255('d * (255 - a)')}, 255)"
_I = f"least({_R} + 100 - " + d255(f"{_R} * 100") + ", 255)"


@query("group_knockout", PX + f"SELECT s, d, a, CAST({_R} AS BIGINT) AS result, CAST({_I} AS BIGINT) AS here, CAST(CASE WHEN {_R} = 0 THEN 0 ELSE (({_I} - s) * d + s * a) // greatest({_I}, 1) END AS BIGINT) AS v FROM px")
def group_knockout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knockout group over a backdrop of alpha 100: s is the source's alpha, d the group's, a the shape and colour."""
    s, d, a = (F.col(x) for x in "sda")
    alphas = B.group_alphas(s, d, a, True, long(100))
    return pixels(spark, sf_dir).select("s", "d", "a", alphas[0].alias("result"), alphas[1].alias("here"), B.group_color(a, d, None, s, alphas).alias("v"))


@query("luminosity_soft_mask", PX + "SELECT s, d, a, CASE a % 3 WHEN 0 THEN (77 * s + 151 * d + 28 * a + 128) >> 8 WHEN 1 THEN a ELSE 255 END AS v FROM px")
def luminosity_soft_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.color import luma_blend

    s, d, a = (F.col(x) for x in "sda")
    return pixels(spark, sf_dir).select("s", "d", "a", F.when(a % 3 == 0, luma_blend(s, d, a)).when(a % 3 == 1, a).otherwise(long(255)).alias("v"))


_SHORT = ["BPC", "CS", "W", "Length", "IM", "Width", "Fl", "G"]
_LONG = ["BitsPerComponent", "ColorSpace", "Width", "Length", "ImageMask", "Width", "Fl", "G"]


@query("inline_abbreviations", f"SELECT event_id, list_extract({_LONG}, CAST(event_id % 8 AS INTEGER) + 1) AS key, CASE event_type WHEN 'view' THEN 'FlateDecode' WHEN 'click' THEN 'DCTDecode' WHEN 'purchase' THEN 'CCITTFaxDecode' ELSE event_type END AS filter FROM events")
def inline_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.get(F.array(*[F.lit(k) for k in _SHORT]), (F.col("event_id") % 8).cast("int"))
    short = F.when(F.col("event_type") == "view", "Fl").when(F.col("event_type") == "click", "DCT").when(F.col("event_type") == "purchase", "CCF").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", N.expanded(N.INLINE_KEYS, key).alias("key"), N.expanded(N.INLINE_FILTERS, short).alias("filter"))


@query(
    "colorspace_names",
    """SELECT p_partkey AS obj, CASE p_size % 5 WHEN 4 THEN 'DeviceCMYK' WHEN 3 THEN 'DeviceRGB' ELSE 'DeviceGray' END AS icc, CASE p_size % 6 WHEN 0 THEN 'DeviceGray' WHEN 1 THEN 'DeviceRGB' WHEN 2 THEN 'DeviceRGB' WHEN 3 THEN 'DeviceCMYK' WHEN 4 THEN 'DeviceGray' ELSE 'DeviceGray' END AS family,
      CASE p_size % 4 WHEN 0 THEN 'Multiply' WHEN 1 THEN 'Normal' WHEN 2 THEN 'Screen' ELSE 'Normal' END AS blend, CASE p_size % 5 WHEN 1 THEN 'DeviceGray' WHEN 3 THEN 'DeviceRGB' WHEN 4 THEN 'DeviceCMYK' END AS tint, CASE p_size % 3 WHEN 0 THEN 'DCTDecode' ELSE 'Raw' END AS filter FROM part""",
)
def colorspace_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    pick = lambda names, n: F.get(F.array(*[F.lit(x) for x in names]), (size % n).cast("int"))
    family = pick(["CalGray", "CalRGB", "DeviceRGB", "DeviceCMYK", "Odd", "DeviceGray"], 6)
    blends = pick(["Odd Multiply Screen", "Odd", "Screen Multiply", "Compatible Screen"], 4)
    filters = pick(["ASCII85Decode DCTDecode", "DCTDecode ASCIIHexDecode", "Odd"], 3)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("obj"), N.icc_family(size % 5).alias("icc"), N.device_family(family).alias("family"), N.blend_mode(F.split(blends, " ")).alias("blend"), N.tint_family(size % 5).alias("tint"), N.terminal_filter(F.split(filters, " ")).alias("filter")
    )


@query(
    "reference_chase",
    """WITH RECURSIVE r AS (SELECT p_partkey AS obj, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_partkey - p_partkey % 997 + (p_partkey % 997 * 5 + 3) % 997 END AS next FROM part),
    w AS (SELECT obj, obj AS at, 0 AS n FROM r UNION ALL SELECT w.obj, r.next, w.n + 1 FROM w JOIN r ON r.obj = w.at WHERE r.next IS NOT NULL AND w.n < 32)
    SELECT r.obj, coalesce(max(w.at), -1) AS target, coalesce(max(w.n), -1) AS hops FROM r LEFT JOIN (SELECT w.* FROM w JOIN r ON r.obj = w.at AND r.next IS NULL) w ON w.obj = r.obj GROUP BY r.obj""",
)
def reference_chase(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each 997 parts refer to each other.
    own = F.col("p_partkey") % 997
    following = F.when(F.col("p_size") % 9 != 0, F.col("p_partkey") - own + (own * 5 + 3) % 997)
    refs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("obj"), following.alias("next"))
    return N.resolved(refs).select("obj", F.coalesce("target", F.lit(-1)).alias("target"), F.coalesce("hops", F.lit(-1)).alias("hops"))


@query("pixel_modes", "SELECT * FROM (VALUES ('Mono1', 1, 1, 0, 13), ('Mono8', 1, 8, 1, 100), ('Rgb8', 3, 24, 3, 300), ('Bgr8', 3, 24, 3, 300), ('Xbgr8', 4, 32, 4, 400), ('Cmyk8', 4, 32, 4, 400), ('DeviceN8', 8, 64, 8, 800)) t(mode, components, bits, bytes, row_bytes)")
def pixel_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.color import PIXEL_MODES, row_bytes

    modes = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in PIXEL_MODES])).alias("mode"))
    return modes.select("mode", *[v.alias(k) for k, v in N.pixel_mode(F.col("mode")).items()], row_bytes(F.col("mode"), long(100)).alias("row_bytes"))


@query("prefetch_dedup", "SELECT user_id AS doc, obj, first_page FROM (SELECT user_id, event_id % 40 AS obj, min(event_id) AS first_page, row_number() OVER (PARTITION BY user_id ORDER BY min(event_id)) AS rank FROM events GROUP BY 1, 2) WHERE rank <= 20")
def prefetch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each image of a document once, by its first use, up to a number of images."""
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), (F.col("event_id") % 40).alias("obj")).agg(F.min("event_id").alias("first_page"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy("first_page"))).where("rank <= 20").drop("rank")


@query(
    "clip_pixel_intersection",
    "WITH a AS (SELECT DISTINCT l_orderkey % 20 AS clip, l_partkey % 40 AS x, l_suppkey % 10 AS y FROM lineitem WHERE l_linenumber <= 3), b AS (SELECT DISTINCT l_orderkey % 20 AS clip, l_partkey % 40 AS x, l_suppkey % 10 AS y FROM lineitem WHERE l_linenumber > 3) SELECT * FROM a INTERSECT SELECT * FROM b",
)
def clip_pixel_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).alias("clip"), (F.col("l_partkey") % 40).alias("x"), (F.col("l_suppkey") % 10).alias("y"), "l_linenumber")
    one, two = rows.where("l_linenumber <= 3").drop("l_linenumber"), rows.where("l_linenumber > 3").drop("l_linenumber")
    return one.intersect(two)


def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts through filters and back through the engine's decoders."""
    from quire.sources.filters import decode_chain

    for batch in batches:
        out = []
        for text, k in zip(batch.column("text"), batch.column("doc_id")):
            data = (text.as_py() or "").encode()
            packed = [
                (base64.a85encode(zlib.compress(data, 1)) + b"~>", ["ASCII85Decode", "FlateDecode"]),
                (data.hex().encode() + b">", ["AHx"]),
                (b"".join(bytes([len(data[i : i + 100]) - 1]) + data[i : i + 100] for i in range(0, len(data), 100)) + b"\x80", ["RunLengthDecode"]),
                (zlib.compress(b"".join(b"\0" + data[i : i + 50] for i in range(0, len(data), 50)), 1), ["Fl"]),
            ][k.as_py() % 4]
            parms = [{"Predictor": 15, "Columns": 50}] if packed[1] == ["Fl"] else []
            out.append(decode_chain(packed[0], packed[1], parms)[0][: len(data)])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "data"])


@query("stream_filters_roundtrip", "SELECT doc_id, sha256(coalesce(text, '')) AS digest FROM documents")
def stream_filters_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.mapInArrow(filtered, "doc_id long, data binary").select("doc_id", F.sha2("data", 256).alias("digest"))
