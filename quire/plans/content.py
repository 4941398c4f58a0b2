"""Queries of the content operators: events stand for the operators of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.operators import content as C
from quire.plans.registry import query, table

EV = "ev AS (SELECT event_id, user_id AS page, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type AS et, CAST(floor(value) AS BIGINT) AS v FROM events)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", F.col("user_id").alias("page"), F.row_number().over(w).cast("long").alias("seq"), F.col("event_type").alias("et"), F.floor("value").cast("long").alias("v"))


def as_ops(rows: DataFrame, ops: dict[str, str], nums=None) -> DataFrame:
    """Events as operators, by type; ``nums``: an array column."""
    op = F.element_at(F.create_map(*[F.lit(x) for pair in ops.items() for x in pair]), F.col("et"))
    return rows.withColumn("op", op).withColumn("nums", F.array().cast("array<bigint>") if nums is None else nums)


KEYWORDS = ["q", "Q", "cm", "re", "l", "v", "f*", "b", "W*", "Tf", "TJ", "scn", "k", "Do", "BDC", "zz", "BX", "d1"]
KINDS = [C.VARIANTS.get(k, "Unknown") for k in KEYWORDS]


@query("ops_variants", f"SELECT kind, count(*) AS n, min(event_id) AS first FROM (SELECT event_id, list_extract({KINDS}, CAST(event_id % {len(KINDS)} AS INTEGER) + 1) AS kind FROM events) GROUP BY kind")
def ops_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.get(F.array(*[F.lit(k) for k in KEYWORDS]), (F.col("event_id") % len(KEYWORDS)).cast("int"))
    return table(spark, sf_dir, "events").groupBy(C.variant(op).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first"))


@query(
    "gstate_clamped_depth",
    f"""WITH RECURSIVE {EV}, sim AS (
      SELECT page, seq, event_id, CASE WHEN et = 'view' THEN 1 ELSE 0 END AS depth FROM ev WHERE seq = 1
      UNION ALL SELECT e.page, e.seq, e.event_id, greatest(s.depth + CASE e.et WHEN 'view' THEN 1 WHEN 'click' THEN -1 ELSE 0 END, 0) FROM sim s JOIN ev e ON e.page = s.page AND e.seq = s.seq + 1)
    SELECT event_id, CAST(depth AS BIGINT) AS depth FROM sim""",
)
def gstate_clamped_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.when(F.col("et") == "view", 1).when(F.col("et") == "click", -1).otherwise(0)
    return C.clamped_depth(events(spark, sf_dir), ["page"], step).select("event_id", "depth")


@query(
    "graphics_state_fold",
    f"""WITH RECURSIVE {EV}, sim AS (
      SELECT page, 0::BIGINT AS seq, 1::BIGINT AS w, [1, 0, 0, 1, 0, 0]::BIGINT[] AS m, []::STRUCT(w BIGINT, m BIGINT[])[] AS stack, '' AS et FROM ev WHERE seq = 1
      UNION ALL SELECT e.page, e.seq,
        CASE WHEN e.et = 'purchase' THEN e.v WHEN e.et = 'click' AND len(s.stack) > 0 THEN s.stack[len(s.stack)].w ELSE s.w END,
        CASE WHEN e.et = 'signup' THEN [s.m[1] + (e.v % 2) * s.m[3], s.m[2] + (e.v % 2) * s.m[4], s.m[3], s.m[4], (e.v % 5) * s.m[1] + (e.v % 3) * s.m[3] + s.m[5], (e.v % 5) * s.m[2] + (e.v % 3) * s.m[4] + s.m[6]]
          WHEN e.et = 'click' AND len(s.stack) > 0 THEN s.stack[len(s.stack)].m ELSE s.m END,
        CASE WHEN e.et = 'view' THEN list_append(s.stack, {{'w': s.w, 'm': s.m}}) WHEN e.et = 'click' AND len(s.stack) > 0 THEN s.stack[1:len(s.stack) - 1] ELSE s.stack END, e.et
      FROM sim s JOIN ev e ON e.page = s.page AND e.seq = s.seq + 1)
    SELECT page, seq, w AS line_width, m[1] AS a, m[2] AS b, m[3] AS c, m[4] AS d, m[5] AS e, m[6] AS f FROM sim WHERE et = 'error'""",
)
def graphics_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    nums = F.when(F.col("et") == "signup", F.array(one, v % 2, none, one, v % 5, v % 3)).otherwise(F.array(v))
    ops = as_ops(events(spark, sf_dir), {"view": "q", "click": "Q", "purchase": "w", "signup": "cm", "error": "f"}, nums)
    rows = C.graphics_states(ops, ["page"], {"f"})
    return rows.select("page", "seq", F.col("line_width").cast("long").alias("line_width"), *[F.get("ctm", i).cast("long").alias(n) for i, n in enumerate("abcdef")])


@query(
    "path_points",
    f"""WITH {EV}, p AS (SELECT *, v % 50 AS x, v // 7 AS y, v % 13 + 1 AS x2, v % 11 + 2 AS y2,
      last_value(CASE WHEN et IN ('view', 'error') THEN v % 50 END IGNORE NULLS) OVER w AS sx, last_value(CASE WHEN et IN ('view', 'error') THEN v // 7 END IGNORE NULLS) OVER w AS sy
      FROM ev WINDOW w AS (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING)),
    q AS (SELECT *, CASE et WHEN 'purchase' THEN x2 WHEN 'signup' THEN sx ELSE x END AS ex, CASE et WHEN 'purchase' THEN y2 WHEN 'signup' THEN sy ELSE y END AS ey FROM p),
    r AS (SELECT *, last_value(ex IGNORE NULLS) OVER w AS hx, last_value(ey IGNORE NULLS) OVER w AS hy FROM q WHERE et IN ('view', 'error') OR sx IS NOT NULL
      WINDOW w AS (PARTITION BY page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT page, seq, k, x, y, curve FROM (
      SELECT page, seq, 0 AS k, x, y, false AS curve FROM r WHERE et IN ('view', 'click') AND (et = 'view' OR hx IS NOT NULL)
      UNION ALL SELECT page, seq, 0, sx, sy, false FROM r WHERE et = 'signup' AND hx IS NOT NULL
      UNION ALL SELECT page, seq, 0, hx, hy, true FROM r WHERE et = 'purchase' AND hx IS NOT NULL
      UNION ALL SELECT page, seq, 1, x, y, true FROM r WHERE et = 'purchase' AND hx IS NOT NULL
      UNION ALL SELECT page, seq, 2, x2, y2, true FROM r WHERE et = 'purchase' AND hx IS NOT NULL
      UNION ALL SELECT page, seq, k, x + CASE WHEN k IN (1, 2) THEN x2 ELSE 0 END, y + CASE WHEN k IN (2, 3) THEN y2 ELSE 0 END, false FROM r, generate_series(0, 4) g(k) WHERE et = 'error')""",
)
def path_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("v")
    nums = F.array(v % 50, F.call_function("div", v, F.lit(7).cast("long")), v % 13 + 1, v % 11 + 2)
    ops = as_ops(events(spark, sf_dir), {"view": "m", "click": "l", "purchase": "v", "signup": "h", "error": "re"}, nums)
    return C.path_points(ops, ["page"])


@query(
    "paint_kinds",
    f"""WITH {EV} SELECT page, seq, 'fill' AS kind, 'nz' AS rule, et = 'purchase' AS closes FROM ev WHERE et IN ('view', 'purchase')
    UNION ALL SELECT page, seq, 'fill', 'eo', false FROM ev WHERE et = 'click'
    UNION ALL SELECT page, seq, 'stroke', NULL, et = 'purchase' FROM ev WHERE et IN ('click', 'purchase', 'signup')""",
)
def paint_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.paints(as_ops(events(spark, sf_dir), {"view": "f", "click": "B*", "purchase": "b", "signup": "S", "error": "n"}), ["page"])


@query(
    "pending_clip",
    f"""WITH {EV}, g AS (SELECT *, coalesce(sum(CASE WHEN et IN ('view', 'click') THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS path FROM ev)
    SELECT page, max(seq) FILTER (et IN ('view', 'click')) AS seq, arg_max(CASE et WHEN 'purchase' THEN 'nz' ELSE 'eo' END, seq) FILTER (et IN ('purchase', 'signup')) AS rule
    FROM g GROUP BY page, path HAVING count(*) FILTER (et IN ('view', 'click')) > 0 AND count(*) FILTER (et IN ('purchase', 'signup')) > 0""",
)
def pending_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.clips(as_ops(events(spark, sf_dir), {"view": "f", "click": "n", "purchase": "W", "signup": "W*", "error": "re"}), ["page"])


@query(
    "device_colors",
    """WITH c AS (SELECT DISTINCT l_returnflag AS flag, l_discount * 8 AS a, l_tax * 10 AS b, l_quantity / 50 AS c, l_linenumber / 8.0::DOUBLE AS d FROM lineitem),
    u AS (SELECT *, CAST(floor(least(greatest(a, 0), 1) * 255 + 0.5) AS BIGINT) AS ua, CAST(floor(least(greatest(b, 0), 1) * 255 + 0.5) AS BIGINT) AS ub, CAST(floor(least(greatest(c, 0), 1) * 255 + 0.5) AS BIGINT) AS uc, CAST(floor(least(greatest(d, 0), 1) * 255 + 0.5) AS BIGINT) AS ud FROM c)
    SELECT flag, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, CASE flag WHEN 'A' THEN ua WHEN 'N' THEN ua ELSE ((255 - ua) * (255 - ud) + 127) // 255 END AS r,
      CASE flag WHEN 'A' THEN ua WHEN 'N' THEN ub ELSE ((255 - ub) * (255 - ud) + 127) // 255 END AS g, CASE flag WHEN 'A' THEN ua WHEN 'N' THEN uc ELSE ((255 - uc) * (255 - ud) + 127) // 255 END AS bl FROM u""",
)
def device_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS flag", "l_discount * 8 AS a", "l_tax * 10 AS b", "l_quantity / 50 AS c", "l_linenumber / CAST(8.0 AS DOUBLE) AS d").distinct()
    op = F.when(F.col("flag") == "A", "g").when(F.col("flag") == "N", "rg").otherwise("k")
    color = C.device_color(op, F.array("a", "b", "c", "d"))
    return rows.select("flag", *[F.round(x, 6).alias(x) for x in "abcd"], color.alias("rgb")).select("flag", *"abcd", "rgb.r", "rgb.g", F.col("rgb.b").alias("bl"))


@query(
    "optional_content",
    f"""WITH RECURSIVE {EV}, sim AS (
      SELECT page, 0::BIGINT AS seq, NULL::BIGINT AS event_id, []::BIGINT[] AS open FROM ev WHERE seq = 1
      UNION ALL SELECT e.page, e.seq, e.event_id, CASE WHEN e.et = 'view' THEN list_append(s.open, 0::BIGINT) WHEN e.et = 'purchase' THEN list_append(s.open, 1::BIGINT) WHEN e.et IN ('click', 'signup') AND len(s.open) > 0 THEN s.open[1:len(s.open) - 1] ELSE s.open END
      FROM sim s JOIN ev e ON e.page = s.page AND e.seq = s.seq + 1)
    SELECT event_id, list_contains(open, 1) AS hidden FROM sim WHERE event_id IS NOT NULL""",
)
def optional_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    et = F.col("et")
    return C.hidden(events(spark, sf_dir), ["page"], et.isin("view", "purchase"), et.isin("click", "signup"), et == "purchase").select("event_id", "hidden")


@query(
    "text_line_positions",
    f"""WITH {EV}, a AS (SELECT *, coalesce(last_value(CASE WHEN et = 'purchase' THEN v % 20 END IGNORE NULLS) OVER w, 0) AS lead_, sum(CASE WHEN et IN ('signup', 'error') THEN 1 ELSE 0 END) OVER w AS obj FROM ev WINDOW w AS (PARTITION BY page ORDER BY seq ROWS UNBOUNDED PRECEDING))
    SELECT event_id, CAST(sum(CASE et WHEN 'view' THEN v % 20 WHEN 'error' THEN v % 9 ELSE 0 END) OVER l AS BIGINT) AS tx, CAST(sum(CASE et WHEN 'view' THEN v % 7 WHEN 'error' THEN v % 5 WHEN 'click' THEN -lead_ ELSE 0 END) OVER l AS BIGINT) AS ty
    FROM a WINDOW l AS (PARTITION BY page, obj ORDER BY seq ROWS UNBOUNDED PRECEDING)""",
)
def text_line_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, zero = F.col("v"), F.lit(0).cast("long")
    nums = F.when(F.col("et") == "error", F.array(zero, zero, zero, zero, v % 9, v % 5)).otherwise(F.array(v % 20, v % 7))
    ops = as_ops(events(spark, sf_dir), {"view": "Td", "click": "T*", "purchase": "TL", "signup": "BT", "error": "Tm"}, nums)
    return C.text_lines(ops, ["page"]).select("event_id", "tx", "ty")


@query(
    "unknown_operators",
    f"""WITH {EV}, f AS (SELECT page, 'op' || (v % 40) AS op, min(seq) AS seq FROM ev WHERE et IN ('error', 'click') GROUP BY 1, 2)
    SELECT page, op, CAST(rank AS INTEGER) AS rank FROM (SELECT page, op, row_number() OVER (PARTITION BY page ORDER BY seq) AS rank FROM f) WHERE rank <= 8""",
)
def unknown_operators(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = events(spark, sf_dir).withColumn("op", F.concat(F.lit("op"), (F.col("v") % 40).cast("string")))
    return C.unknown_report(ops, ["page"], ~F.col("et").isin("error", "click"), 8)


@query(
    "operand_stack",
    f"""WITH {EV}, g AS (SELECT *, coalesce(sum(CASE WHEN et = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM ev)
    SELECT page, max(seq) FILTER (et = 'error') AS seq, coalesce(string_agg(CASE WHEN et <> 'error' THEN CAST(v AS VARCHAR) END, ' ' ORDER BY seq), '') AS operands, CAST(count(*) FILTER (et <> 'error') AS INTEGER) AS n
    FROM g GROUP BY page, grp HAVING count(*) FILTER (et = 'error') > 0""",
)
def operand_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = events(spark, sf_dir).withColumn("token", F.col("v").cast("string"))
    rows = C.grouped_operands(tokens, ["page"], F.col("et") == "error")
    return rows.select("page", "seq", F.array_join("operands", " ").alias("operands"), F.size("operands").alias("n"))


@query(
    "form_expansion",
    """WITH RECURSIVE uses AS (SELECT p_partkey AS form, 0 AS ord, p_partkey * 2 + 1 AS child FROM part UNION ALL SELECT p_partkey, 1, p_partkey * 2 + 2 FROM part UNION ALL SELECT p_partkey, 2, p_partkey // 4 FROM part WHERE p_partkey % 16 = 5),
    r AS (SELECT p_partkey AS root, p_partkey AS form, '' AS path, [p_partkey] AS above FROM part
      UNION ALL SELECT r.root, u.child, CASE WHEN path = '' THEN '' ELSE path || '.' END || u.ord, list_append(above, u.child) FROM r JOIN uses u ON u.form = r.form WHERE u.child IN (SELECT p_partkey FROM part) AND NOT list_contains(above, u.child) AND len(above) <= 9)
    SELECT root, form, path FROM r""",
)
def form_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("form"))
    kids = [(0, F.col("form") * 2 + 1, F.lit(True)), (1, F.col("form") * 2 + 2, F.lit(True)), (2, F.floor(F.col("form") / 4), F.col("form") % 16 == 5)]
    uses = None
    for ord_, child, on in kids:
        own = part.where(on).select("form", F.lit(ord_).alias("ord"), child.cast("long").alias("child"))
        uses = own if uses is None else uses.unionByName(own)
    forms = part.select(F.col("form").alias("child")).distinct()
    return C.form_expansion(uses.join(forms, "child", "left_semi"), part, 9)


@query(
    "js_locations",
    """SELECT user_id AS doc, string_agg(DISTINCT loc, ',' ORDER BY loc) AS locations FROM (
      SELECT user_id, CASE event_type WHEN 'view' THEN 'OpenAction' WHEN 'click' THEN 'AA' WHEN 'purchase' THEN 'Names' WHEN 'signup' THEN 'Page' ELSE 'Annot' END AS loc FROM events WHERE value > 95) GROUP BY user_id""",
)
def js_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of scans of the places where scripts can be, one set of names a document."""
    places = {"view": "OpenAction", "click": "AA", "purchase": "Names", "signup": "Page", "error": "Annot"}
    rows = table(spark, sf_dir, "events").where("value > 95")
    loc = F.element_at(F.create_map(*[F.lit(x) for p in places.items() for x in p]), F.col("event_type"))
    return rows.groupBy(F.col("user_id").alias("doc")).agg(F.array_join(F.array_sort(F.collect_set(loc)), ",").alias("locations"))


@query(
    "error_report",
    """SELECT o_custkey AS doc, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS errors, coalesce(min(o_orderkey) FILTER (o_orderstatus = 'F'), -1) AS first_page, CAST(CASE WHEN count(*) FILTER (o_orderstatus = 'F') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM orders GROUP BY o_custkey""",
)
def error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count_if(failed).alias("errors"), F.coalesce(F.min(F.when(failed, F.col("o_orderkey"))), F.lit(-1)).alias("first_page"), F.max(F.when(failed, 1).otherwise(0)).alias("exit_code"))


@query(
    "page_cursor",
    "WITH m AS (SELECT DISTINCT l_orderkey AS doc, CAST(l_linenumber AS BIGINT) AS page FROM lineitem) SELECT doc, page, coalesce(lead(page) OVER (PARTITION BY doc ORDER BY page), 0) AS next_page FROM m WHERE page >= 2",
)
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("long").alias("page")).distinct().where("page >= 2")
    return pages.withColumn("next_page", F.coalesce(F.lead("page").over(Window.partitionBy("doc").orderBy("page")), F.lit(0)))
