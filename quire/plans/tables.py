"""Queries of the page, lookup, window and raster operators over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G
from quire.functions.color import div
from quire.operators import pages as P
from quire.operators import raster as R
from quire.plans.registry import query, table


def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (doc, page, x, y, v): lineitem as marks on pages."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page"), (F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), F.col("l_quantity").cast("long").alias("v")).distinct()


MARKS = "WITH m AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS page, l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(l_quantity AS BIGINT) AS v FROM lineitem) "


@query("page_range_parity", MARKS + "SELECT DISTINCT doc, page FROM m WHERE page BETWEEN 2 AND 6 AND page % 2 = 1")
def page_range_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.page_range(marks(spark, sf_dir).select("doc", "page").distinct(), F.lit(7), 2, 6, "odd")


@query("singlefile", MARKS + "SELECT doc, min(page) AS page FROM m GROUP BY doc")
def singlefile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.first_page(marks(spark, sf_dir), "doc")


@query("page_set_semi", MARKS + "SELECT DISTINCT m.doc, m.page FROM m SEMI JOIN (SELECT o_orderkey AS doc, CAST(o_custkey % 8 AS BIGINT) AS page FROM orders WHERE o_custkey % 8 >= 1) w USING (doc, page)")
def page_set_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 8).alias("page"))
    return P.page_set(marks(spark, sf_dir).select("doc", "page").distinct(), wanted, "doc")


@query(
    "page_resolve_errors",
    MARKS + "SELECT w.doc, w.page, CASE WHEN p.doc IS NULL THEN 'PageOutOfRange' END AS error FROM (SELECT o_orderkey AS doc, o_custkey % 8 AS page FROM orders) w LEFT JOIN (SELECT DISTINCT doc, page FROM m) p ON p.doc = w.doc AND p.page = w.page",
)
def page_resolve_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 8).alias("page"))
    return P.resolve_pages(wanted, marks(spark, sf_dir).select("doc", "page").distinct(), "doc")


@query(
    "output_naming",
    "SELECT o_orderkey AS doc, 'out-' || lpad(CAST(o_custkey % 100 + 1 AS VARCHAR), CAST(length(CAST(o_custkey % 100 + 50 AS VARCHAR)) AS INTEGER), '0') || '.' || CASE WHEN o_orderstatus = 'F' THEN 'png' WHEN o_orderkey % 3 = 0 THEN 'pbm' WHEN o_orderkey % 3 = 1 THEN 'pgm' ELSE 'ppm' END AS name FROM orders WHERE length(CAST(o_custkey % 100 + 1 AS VARCHAR)) <= length(CAST(o_custkey % 100 + 50 AS VARCHAR))",
)
def output_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey") % 3
    fmt = F.when(F.col("o_orderstatus") == "F", "png").otherwise("ppm")
    name = P.output_name(F.lit("out"), F.col("o_custkey") % 100 + 1, F.col("o_custkey") % 100 + 50, P.extension(fmt, key == 0, key == 1))
    return rows.select(F.col("o_orderkey").alias("doc"), name.alias("name"))


@query("xref_latest_wins", "SELECT user_id AS obj, event_id, event_type AS kind FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def xref_latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = P.latest_wins(table(spark, sf_dir, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])
    return rows.select(F.col("user_id").alias("obj"), "event_id", F.col("event_type").alias("kind"))


_TREE = """nodes AS (
 SELECT 'r' || r_regionkey AS node, 'root' AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
 UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("region", "r", "r_regionkey", None), ("nation", "n", "n_nationkey", ("r", "n_regionkey")), ("customer", "c", "c_custkey", ("n", "c_nationkey"))]
    out = None
    for name, letter, key, up in parts:
        node = F.concat(F.lit(letter), F.col(key).cast("string")).alias("node")
        parent = (F.concat(F.lit(up[0]), F.col(up[1]).cast("string")) if up else F.lit("root")).alias("parent")
        rows = table(spark, sf_dir, name).select(node, parent)
        out = rows if out is None else out.unionByName(rows)
    return out


@query("page_tree_recursive", f"WITH RECURSIVE {_TREE}, walk AS (SELECT node, 1 AS depth FROM nodes WHERE parent = 'root' UNION ALL SELECT n.node, w.depth + 1 FROM walk w JOIN nodes n ON n.parent = w.node WHERE w.depth < 64) SELECT node, CAST(depth AS INTEGER) AS depth FROM walk")
def page_tree_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(
        "WITH RECURSIVE walk(node, depth) AS (SELECT node, 1 FROM {nodes} WHERE parent = 'root' UNION ALL "
        "SELECT n.node, w.depth + 1 FROM walk w JOIN {nodes} n ON n.parent = w.node WHERE w.depth < 64) SELECT node, depth FROM walk",
        nodes=_tree(spark, sf_dir),
    )


@query(
    "inherited_attribute",
    "SELECT c.c_custkey AS page, coalesce(CASE WHEN c.c_acctbal > 5000 THEN c.c_acctbal END, CASE WHEN n.n_nationkey % 3 = 0 THEN CAST(n.n_nationkey AS DOUBLE) END, CAST(r.r_regionkey AS DOUBLE)) AS box FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
)
def inherited_attribute(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    own, up = F.when(F.col("c_acctbal") > 5000, F.col("c_acctbal")), F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey").cast("double"))
    return rows.select(F.col("c_custkey").alias("page"), F.coalesce(own, up, F.col("r_regionkey").cast("double")).alias("box"))


@query("page_tree_prefix_sum", "SELECT n_regionkey AS parent, n_nationkey AS node, n AS leaves, coalesce(CAST(sum(n) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before FROM (SELECT n_regionkey, n_nationkey, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)")
def page_tree_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    counts = n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("node")).agg(F.count("c_custkey").alias("leaves"))
    return P.subtree_sums(counts, "parent", "node", "leaves")


_ORD = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END"


@query("dominant_filter", f"SELECT user_id AS page, filter, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, o DESC) AS r FROM (SELECT user_id, event_type AS filter, count(*) AS n, max({_ORD}) AS o FROM events GROUP BY 1, 2)) WHERE r = 1")
def dominant_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("page"), F.col("event_type").alias("filter"))
    ordinal = F.when(F.col("filter") == "click", 0).when(F.col("filter") == "error", 1).when(F.col("filter") == "purchase", 2).when(F.col("filter") == "signup", 3).otherwise(4)
    return P.dominant(rows, ["page"], "filter", ordinal)


@query("page_flags", "SELECT user_id AS page, bool_or(event_type = 'view') AS has_images, bool_or(event_type = 'error') AS has_text, max(value) AS max_ppi FROM events GROUP BY user_id")
def page_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("page")).agg(F.bool_or(F.col("event_type") == "view").alias("has_images"), F.bool_or(F.col("event_type") == "error").alias("has_text"), F.max("value").alias("max_ppi"))


@query("suggested_dpi", "SELECT o_orderkey AS doc, least(greatest(coalesce(min(step) FILTER (step >= o_totalprice / 1000), 600.0), 150.0), 400.0)::DOUBLE AS dpi FROM orders, (SELECT unnest([72, 96, 150, 200, 300, 400, 600])::DOUBLE AS step) GROUP BY o_orderkey")
def suggested_dpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), G.suggested_dpi(F.col("o_totalprice") / 1000, 150, 400).alias("dpi"))


@query("page_pixel_guards", "SELECT o_orderkey AS doc, w, h, CASE WHEN w <= 0 OR h <= 0 THEN 'PageDegenerate' WHEN w > 32768 OR h > 32768 THEN 'PageTooLarge' WHEN w * h > 600000000 THEN 'PageAreaTooLarge' END AS error FROM (SELECT o_orderkey, CAST(floor((o_custkey % 12000 - 3) * 300 / 72.0::DOUBLE + 0.5) AS BIGINT) AS w, CAST(floor((o_orderkey % 7000) * 300 / 72.0::DOUBLE + 0.5) AS BIGINT) AS h FROM orders)")
def page_pixel_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    w, h = G.page_pixels((F.col("o_custkey") % 12000 - 3).cast("double"), (F.col("o_orderkey") % 7000).cast("double"), F.lit(300))
    sized = rows.select(F.col("o_orderkey").alias("doc"), w.alias("w"), h.alias("h"))
    return sized.select("doc", "w", "h", G.page_error(F.col("w"), F.col("h")).alias("error"))


_M = "l_quantity AS a, l_linenumber::DOUBLE AS b, l_discount * 100 AS c, l_tax * 100 AS d, (l_partkey % 50)::DOUBLE AS e, (l_suppkey % 50)::DOUBLE AS f"


@query("matrix_product", f"SELECT DISTINCT round(a * c + b * e, 6) AS m0, round(a * d + b * f, 6) AS m1, round(c * c + d * e, 6) AS m2, round(c * d + d * f, 6) AS m3, round(e * c + f * e + 1, 6) AS m4, round(e * d + f * f + 2, 6) AS m5 FROM (SELECT {_M} FROM lineitem)")
def matrix_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_quantity AS a", "CAST(l_linenumber AS DOUBLE) AS b", "l_discount * 100 AS c", "l_tax * 100 AS d", "CAST(l_partkey % 50 AS DOUBLE) AS e", "CAST(l_suppkey % 50 AS DOUBLE) AS f")
    a, b, c, d, e, f = (F.col(x) for x in "abcdef")
    product = G.matrix_product((a, b, c, d, e, f), (c, d, e, f, F.lit(1.0), F.lit(2.0)))
    return rows.select(*[F.round(x, 6).alias(f"m{i}") for i, x in enumerate(product)]).distinct()


@query("to_device", "SELECT DISTINCT l_quantity * 2 + (l_partkey % 100) AS x, 792 - (l_quantity * 3 + (l_suppkey % 100)) AS y FROM lineitem")
def to_device(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    m = (F.lit(2.0), F.lit(0.0), F.lit(0.0), F.lit(3.0), (F.col("l_partkey") % 100).cast("double"), (F.col("l_suppkey") % 100).cast("double"))
    x, y = G.to_device(m, q, q, F.lit(792.0))
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y")).distinct()


@query(
    "box_intersection",
    "SELECT doc, CASE WHEN ok THEN greatest(0, x0) ELSE 0 END AS x0, CASE WHEN ok THEN greatest(0, y0) ELSE 0 END AS y0, CASE WHEN ok THEN least(50, x1) ELSE 50 END AS x1, CASE WHEN ok THEN least(60, y1) ELSE 60 END AS y1 FROM (SELECT *, greatest(0, x0) < least(50, x1) AND greatest(0, y0) < least(60, y1) AS ok FROM (SELECT o_orderkey AS doc, least(o_custkey % 97, o_orderkey % 89) - 10 AS x0, least(o_custkey % 83, o_orderkey % 71) AS y0, greatest(o_custkey % 97, o_orderkey % 89) - 10 AS x1, greatest(o_custkey % 83, o_orderkey % 71) AS y1 FROM orders))",
)
def box_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    box = G.normalized_box(c % 97 - 10, c % 83, o % 89 - 10, o % 71)
    both = G.box_intersection([F.lit(v).cast("long") for v in (0, 0, 50, 60)], box)
    return table(spark, sf_dir, "orders").select(o.alias("doc"), *[v.alias(k) for k, v in zip(("x0", "y0", "x1", "y1"), both)])


@query("clip_span_test", MARKS + "SELECT DISTINCT x, y, CASE WHEN greatest(x, y) < 20 OR least(x, y) > 40 THEN 'AllOutside' WHEN least(x, y) >= 20 AND greatest(x, y) <= 40 THEN 'AllInside' ELSE 'Partial' END AS lies FROM m")
def clip_span_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).select("x", "y", G.span_test(F.least("x", "y"), F.greatest("x", "y"), F.lit(20), F.lit(40)).alias("lies")).distinct()


@query(
    "cid_width_range_join",
    "WITH seg AS (SELECT p_partkey AS ord, (p_partkey * 37) % 2000 AS first, (p_partkey * 37) % 2000 + p_size AS last, CAST(p_size * 10 AS BIGINT) AS w FROM part), probe AS (SELECT DISTINCT l_partkey AS cid FROM lineitem) SELECT cid, coalesce(arg_min(w, ord), 1000) AS width FROM probe LEFT JOIN seg ON cid BETWEEN first AND last GROUP BY cid",
)
def cid_width_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "part").selectExpr("p_partkey AS ord", "(p_partkey * 37) % 2000 AS first", "(p_partkey * 37) % 2000 + p_size AS last", "CAST(p_size * 10 AS BIGINT) AS w")
    return P.interval_lookup(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("cid")).distinct(), segments, [], "cid", F.lit(1000))


@query("stitching_index", "SELECT event_id, (CASE WHEN value >= 10 THEN 1 ELSE 0 END) + (CASE WHEN value >= 50 THEN 1 ELSE 0 END) + (CASE WHEN value >= 75 THEN 1 ELSE 0 END) AS part FROM events")
def stitching_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", P.stitch_index(F.col("value"), F.array(F.lit(10.0), F.lit(50.0), F.lit(75.0))).alias("part"))


@query("indexed_palette", MARKS + "SELECT m.doc, m.page, m.x, m.y, p.r FROM m JOIN (SELECT p_partkey AS idx, CAST(p_size * 5 AS BIGINT) AS r FROM part WHERE p_partkey < 50) p ON p.idx = least(m.x, 49)")
def indexed_palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    palette = table(spark, sf_dir, "part").where("p_partkey < 50").select(F.col("p_partkey").alias("idx"), (F.col("p_size") * 5).cast("long").alias("r"))
    m = marks(spark, sf_dir)
    return m.join(F.broadcast(palette), F.least(m["x"], F.lit(49)) == palette["idx"]).select("doc", "page", "x", "y", "r")  # 50 rows


@query("ocg_visibility", "SELECT event_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 80))")
def ocg_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    off = e.where("event_type = 'error'").select("user_id").distinct()
    on = e.where("event_type = 'signup' AND value > 80").select("user_id").distinct()
    return P.visible(e, off, on, "user_id").select("event_id")


@query("content_hash_dedup", "SELECT min(doc_id) AS doc_id, sha256(text) AS hash, count(*) AS copies FROM documents GROUP BY sha256(text)")
def content_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(P.digest(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


@query("bounding_boxes", MARKS + "SELECT doc, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM m GROUP BY doc")
def bounding_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marks(spark, sf_dir).groupBy("doc").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))


@query("blelloch_exclusive_scan", "SELECT l_suppkey AS row, n, coalesce(CAST(sum(n) OVER (ORDER BY l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS start FROM (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1)")
def blelloch_exclusive_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return R.exclusive_sums(counts, [], ["row"], "n")


@query("dc_chain", "SELECT event_id, CAST(sum(delta) OVER (PARTITION BY user_id, restart ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS dc FROM (SELECT event_id, user_id, ts, CAST(floor(value) AS BIGINT) AS delta, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS restart FROM events)")
def dc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("delta", F.floor("value").cast("long"))
    return R.restart_chain(rows, ["user_id"], ["ts", "event_id"], "delta", F.col("event_type") == "error").select("event_id", "dc")


@query("carried_state", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS width FROM events")
def carried_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn("set", F.when(F.col("event_type") == "purchase", F.col("value")))
    return rows.select("event_id", R.carried(rows, ["user_id"], ["ts", "event_id"], "set").alias("width"))


@query("gstate_depth", "SELECT event_id, CAST(sum(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS depth FROM events")
def gstate_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", -1).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.sum(step).over(w).alias("depth"))


@query("text_advance", "SELECT event_id, CAST(coalesce(sum(w) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pen FROM (SELECT *, CAST(floor(value) AS BIGINT) * 12 + CASE WHEN event_type = 'view' THEN 3000 ELSE 500 END AS w FROM events)")
def text_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pen positions in thousandths: width times size, character spacing, word spacing."""
    width = F.floor("value").cast("long") * 12 + F.when(F.col("event_type") == "view", 3000).otherwise(500)
    rows = R.exclusive_sums(table(spark, sf_dir, "events").withColumn("w", width), ["user_id"], ["ts", "event_id"], "w")
    return rows.select("event_id", F.col("start").alias("pen"))


_EDGES = "WITH e AS (SELECT l_orderkey AS paint, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS seg, l_partkey % 64 AS x, l_suppkey % 48 AS y0, l_suppkey % 48 + CAST(l_quantity AS BIGINT) % 16 AS y1, l_linenumber % 2 = 0 AS up FROM lineitem)"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    a, b, up = F.col("l_suppkey") % 48, F.col("l_suppkey") % 48 + F.col("l_quantity").cast("long") % 16, F.col("l_linenumber") % 2 == 0
    x = F.col("l_partkey") % 64
    return rows.select(F.col("l_orderkey").alias("paint"), F.row_number().over(w).cast("long").alias("seg"), x.alias("x0"), F.when(up, b).otherwise(a).alias("y0"), x.alias("x1"), F.when(up, a).otherwise(b).alias("y1"))


_CROSS = _EDGES + ", c AS (SELECT paint, seg, y, x AS lo, x AS hi, CASE WHEN y0 < y AND y0 < y1 THEN CASE WHEN up THEN 1 ELSE -1 END ELSE 0 END AS cnt FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM e))"


@query("edge_scanline_explode", _CROSS + " SELECT paint, seg, y, lo, hi, CAST(cnt AS BIGINT) AS cnt FROM c")
def edge_scanline_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.intersections(R.oriented(_edges(spark, sf_dir)))


def _span_sql(inside: str) -> str:
    return (
        _CROSS + ", w AS (SELECT *, sum(cnt) OVER r - cnt AS was FROM c WINDOW r AS (PARTITION BY paint, y ORDER BY lo, seg ROWS UNBOUNDED PRECEDING)),"
        f" g AS (SELECT *, sum(CASE WHEN {inside} THEN 0 ELSE 1 END) OVER (PARTITION BY paint, y ORDER BY lo, seg ROWS UNBOUNDED PRECEDING) AS run FROM w)"
        " SELECT paint, y, min(lo) AS x0, max(hi) AS x1 FROM g GROUP BY paint, y, run"
    )


@query("winding_spans_nz", _span_sql("was <> 0"))
def winding_spans_nz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spans(R.intersections(R.oriented(_edges(spark, sf_dir))), ["paint"])


@query("winding_spans_eo", _span_sql("was % 2 <> 0"))
def winding_spans_eo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.spans(R.intersections(R.oriented(_edges(spark, sf_dir))), ["paint"], even_odd=True)


@query("covered_pixels", _span_sql("was <> 0").replace(" SELECT paint, y, min(lo)", ", s AS (SELECT paint, y, min(lo)") + ") SELECT paint, count(DISTINCT y * 100000 + x) AS pixels FROM (SELECT paint, y, unnest(range(x0, x1 + 1)) AS x FROM s) GROUP BY paint")
def covered_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.wound_pixels(R.intersections(R.oriented(_edges(spark, sf_dir))), ["paint"])


@query("coverage_popcount_gamma", "SELECT DISTINCT m, CAST([0,4,11,21,32,45,59,74,90,108,126,145,166,187,209,231,255][bit_count(m) + 1] AS BIGINT) AS shape FROM (SELECT (l_partkey * 7919 + l_suppkey) % 65536 AS m FROM lineitem)")
def coverage_popcount_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ((F.col("l_partkey") * 7919 + F.col("l_suppkey")) % 65536).alias("m")
    return table(spark, sf_dir, "lineitem").select(m).distinct().select("m", R.coverage_shape(F.col("m")).alias("shape"))


GRID = "grid AS (SELECT l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(max(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y")).agg(F.max("l_quantity").cast("long").alias("v"))


@query("box_filter_downsample", f"WITH {GRID} SELECT x // 4 AS bx, y // 4 AS by, CAST(sum(v) AS BIGINT) // 16 AS v FROM grid GROUP BY 1, 2 HAVING count(*) = 16")
def box_filter_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.box_means(grid(spark, sf_dir), [], 4)


#: Shears of a page of 64 rows, in 64ths.
SHEARS = list(range(-8, 9))
_PROJ = f"WITH {GRID}, p AS (SELECT k, y + CAST(floor(x * k / 64.0::DOUBLE + 0.5) AS BIGINT) AS row, CAST(sum(255 - v) AS BIGINT) AS ink FROM grid, (SELECT unnest(range(-8, 9)) AS k) GROUP BY 1, 2)"


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheared = grid(spark, sf_dir).withColumn("k", F.explode(F.array(*[F.lit(k).cast("long") for k in SHEARS])))
    return R.projection(sheared, ["k"], F.floor(F.col("x") * F.col("k") / 64 + 0.5).cast("long"))


@query("deskew_projection", _PROJ + " SELECT k, row, ink FROM p")
def deskew_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(spark, sf_dir)


_SCORE = _PROJ + ", s AS (SELECT k, CAST(coalesce(sum(d * d), 0) AS BIGINT) AS score FROM (SELECT k, ink - lag(ink) OVER (PARTITION BY k ORDER BY row) AS d FROM p) GROUP BY k)"


@query("deskew_best_angle", _SCORE + " SELECT k, score FROM s ORDER BY score DESC, k LIMIT 1")
def deskew_best_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = R.row_score(_profile(spark, sf_dir), ["k"])
    return scores.agg(F.max_by(F.struct("k", "score"), F.struct("score", -F.col("k"))).alias("b")).select("b.*")


@query(
    "painters_order",
    MARKS + """, n AS (SELECT x, y, v * 5 AS c, page * 36 AS a, row_number() OVER (PARTITION BY x, y ORDER BY doc, page, v) AS o FROM m),
 f AS (SELECT x, y, list(struct_pack(c := c, a := a) ORDER BY o) AS l FROM n GROUP BY x, y)
 SELECT x, y, CAST(list_reduce(list_prepend(CAST(255 AS BIGINT), list_transform(l, lambda p: p.a * 1000 + p.c)),
   lambda d, p: least((((255 - p // 1000) * d + (p // 1000) * (p % 1000)) + (((255 - p // 1000) * d + (p // 1000) * (p % 1000)) >> 8) + 128) >> 8, 255)) AS BIGINT) AS v FROM f""",
)
def painters_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks(spark, sf_dir).select("x", "y", F.struct("doc", "page", "v").alias("o"), (F.col("v") * 5).alias("c"), (F.col("page") * 36).alias("a"))
    return R.painted(m, ["x", "y"], "o", "c", "a")


_BAYER = " + ".join(f"(CASE WHEN (x >> {k}) & 1 = 0 AND (y >> {k}) & 1 = 0 THEN 0 WHEN (x >> {k}) & 1 = 1 AND (y >> {k}) & 1 = 0 THEN 2 WHEN (x >> {k}) & 1 = 0 THEN 3 ELSE 1 END) * {4 ** (1 - k)}" for k in range(2))


@query("halftone_bayer", f"WITH {GRID} SELECT x, y, CAST(CASE WHEN v * 5 >= least(greatest((({_BAYER}) * 255 + 8) // 16, 1), 255) THEN 255 ELSE 0 END AS BIGINT) AS dot FROM grid")
def halftone_bayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("x", "y", R.halftone(F.col("x"), F.col("y"), F.col("v") * 5, 2).alias("dot"))


@query("tiling_lookup", f"WITH {GRID} SELECT g.x, g.y, t.v AS v FROM grid g JOIN grid t ON t.x = ((g.x - 3) % 8 + 8) % 8 AND t.y = ((g.y - 5) % 8 + 8) % 8")
def tiling_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grid(spark, sf_dir)
    tile = g.where("x < 8 AND y < 8").select(F.col("x").alias("tx"), F.col("y").alias("ty"), "v")
    tx, ty = R.tile_lookup(F.col("x"), F.col("y"), 8, 8, 3, 5)
    return g.select("x", "y").join(F.broadcast(tile), (tx == tile["tx"]) & (ty == tile["ty"])).select("x", "y", "v")  # a tile of 64 pixels


@query("image_quality_metrics", f"WITH {GRID} SELECT y, round(avg(abs(v * 5 - (v * 5 + x) % 256)), 6) AS mae, round(sqrt(avg((v * 5 - (v * 5 + x) % 256) * (v * 5 - (v * 5 + x) % 256))), 6) AS rmse FROM grid GROUP BY y")
def image_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("v") * 5 - (F.col("v") * 5 + F.col("x")) % 256
    return grid(spark, sf_dir).groupBy("y").agg(F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"))


@query("tile_binning", _EDGES + " SELECT paint, seg, ty, x // 16 AS tx FROM (SELECT *, unnest(range(y0 // 16, y1 // 16 + 1)) AS ty FROM e)")
def tile_binning(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.oriented(_edges(spark, sf_dir))
    return rows.select("paint", "seg", F.explode(F.sequence(div(F.col("y0"), 16), div(F.col("y1"), 16))).alias("ty"), div(F.col("x0"), 16).alias("tx"))


@query("image_cache_probe", "SELECT o_orderkey AS doc, coalesce(a.p_partkey, h.p_partkey) AS image FROM orders LEFT JOIN (SELECT * FROM part WHERE p_partkey % 2 = 0) a ON a.p_partkey = o_custkey LEFT JOIN (SELECT min(p_partkey) AS p_partkey, p_size FROM part GROUP BY p_size) h ON h.p_size = o_custkey % 50")
def image_cache_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By document and object first, then by content."""
    part = table(spark, sf_dir, "part")
    alias = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("by_id"))
    content = part.groupBy("p_size").agg(F.min("p_partkey").alias("by_hash"))
    o = table(spark, sf_dir, "orders")
    found = o.join(alias, o["o_custkey"] == alias["by_id"], "left").join(content, o["o_custkey"] % 50 == content["p_size"], "left")
    return found.select(F.col("o_orderkey").alias("doc"), F.coalesce("by_id", "by_hash").alias("image"))


@query("event_window_dedup", "SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id * 10 + length(event_type)) AS n FROM events GROUP BY 1")
def event_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.window("ts", "1 hour")["start"].alias("hour"), (F.col("user_id") * 10 + F.length("event_type")).alias("k")).distinct()
    return rows.groupBy("hour").agg(F.count(F.lit(1)).alias("n"))
