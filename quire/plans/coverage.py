"""Queries of coverage, scaling, dashes, screens and meshes over shapes made of parts and lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.color import div
from quire.operators import coverage as V
from quire.operators.shading import coons_interior
from quire.plans.documents import dealt
from quire.plans.registry import query, table

#: A triangle for each part, as corners; pixels of a 4 x 4 grid.
CORNERS = "p_partkey AS shape, (p_partkey * 7 % 40) / 8.0::DOUBLE AS ax, (p_partkey * 11 % 40) / 8.0::DOUBLE AS ay, (p_partkey * 13 % 40) / 8.0::DOUBLE AS bx, (p_partkey * 17 % 40) / 8.0::DOUBLE AS b_y, (p_partkey * 19 % 40) / 8.0::DOUBLE AS cx, (p_partkey * 23 % 40) / 8.0::DOUBLE AS cy"
EDGES = f"t AS (SELECT {CORNERS} FROM part), e AS (SELECT shape, ax AS x0, ay AS y0, bx AS x1, b_y AS y1 FROM t UNION ALL SELECT shape, bx, b_y, cx, cy FROM t UNION ALL SELECT shape, cx, cy, ax, ay FROM t)"
JITTER = ", ".join(f"({x!r}::DOUBLE, {y!r}::DOUBLE)" for x, y in V.jitter())


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape, edges) of the parts' triangles."""
    k = F.col("p_partkey")
    c = [(k * m % 40) / F.lit(8.0) for m in (7, 11, 13, 17, 19, 23)]
    ring = [(c[0], c[1]), (c[2], c[3]), (c[4], c[5])]
    edges = F.array(*[F.struct(a[0].alias("x0"), a[1].alias("y0"), b[0].alias("x1"), b[1].alias("y1")) for a, b in zip(ring, ring[1:] + ring[:1])])
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(k.alias("shape"), edges.alias("edges"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(shape, px, py, edges) of the parts' triangles over their pixels."""
    return shapes(spark, sf_dir).withColumn("px", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("py", F.explode(F.sequence(F.lit(0), F.lit(3))))


def _jittered(rule: str) -> str:
    return f"""WITH {EDGES}, s(sx, sy) AS (VALUES {JITTER}), g AS (SELECT x.k AS px, y.k AS py FROM generate_series(0, 3) x(k), generate_series(0, 3) y(k)),
    w AS (SELECT shape, px, py, sx, sy, sum(CASE WHEN y0 <= py + sy AND py + sy < y1 AND x0 + (py + sy - y0) / (CASE WHEN y1 = y0 THEN 1.0 ELSE y1 - y0 END) * (x1 - x0) >= px + sx THEN 1
      WHEN y1 <= py + sy AND py + sy < y0 AND x0 + (py + sy - y0) / (CASE WHEN y1 = y0 THEN 1.0 ELSE y1 - y0 END) * (x1 - x0) >= px + sx THEN -1 ELSE 0 END) AS n FROM e, s, g GROUP BY ALL)
    SELECT shape, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, CAST((sum(CASE WHEN {rule} THEN 1 ELSE 0 END) * 255 + 32) // 64 AS BIGINT) AS coverage FROM w GROUP BY shape, px, py"""


@query("jitter_coverage_64", _jittered("n <> 0"))
def jitter_coverage_64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jittered_pixels(shapes(spark, sf_dir), 4, 4)


@query("jitter_coverage_eo", _jittered("n % 2 <> 0"))
def jitter_coverage_eo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.jittered_pixels(shapes(spark, sf_dir), 4, 4, True)


@query(
    "analytic_coverage",
    f"""WITH {EDGES}, d AS (SELECT shape, CASE WHEN y0 < y1 THEN x0 ELSE x1 END AS x0, least(y0, y1) AS y0, CASE WHEN y0 < y1 THEN x1 ELSE x0 END AS x1, greatest(y0, y1) AS y1, CASE WHEN y0 < y1 THEN 1.0::DOUBLE ELSE -1.0 END AS sign FROM e WHERE y0 <> y1),
    g AS (SELECT x.k AS px, y.k AS py FROM generate_series(0, 3) x(k), generate_series(0, 3) y(k)),
    c AS (SELECT *, least(y1, py + 1) - greatest(y0, py) AS len, x0 + (greatest(y0, py) - y0) * ((x1 - x0) / (y1 - y0)) AS a FROM d, g),
    r AS (SELECT *, a + len * ((x1 - x0) / (y1 - y0)) AS b FROM c),
    q AS (SELECT *, least(a, b) AS l, greatest(a, b) AS rr FROM r),
    s AS (SELECT shape, px, py, CASE WHEN len <= 0 THEN 0 ELSE sign * CASE WHEN rr <= px THEN 0 WHEN l >= px + 1 THEN len WHEN rr - l < 1e-6 THEN CASE WHEN (a + b) / 2 >= px + 0.5 THEN len ELSE 0 END ELSE len * (rr - greatest(l, px)) / (rr - l) END END AS area FROM q),
    z AS (SELECT shape, CAST(px AS INTEGER) AS px, CAST(py AS INTEGER) AS py, abs(sum(area)) AS area FROM s GROUP BY ALL)
    SELECT shape, px, py, CAST(floor(least(round(area, 9), 1) * 255.5) AS BIGINT) AS coverage FROM z UNION ALL SELECT shape, x.k::INTEGER, y.k::INTEGER, 0 FROM (SELECT DISTINCT shape FROM e WHERE shape NOT IN (SELECT shape FROM d)), generate_series(0, 3) x(k), generate_series(0, 3) y(k)""",
)
def analytic_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triangles(spark, sf_dir)

    def oriented(e):
        up = e["y0"] < e["y1"]
        pick = lambda a, b: F.when(up, e[a]).otherwise(e[b])
        return F.struct(pick("x0", "x1").alias("x0"), pick("y0", "y1").alias("y0"), pick("x1", "x0").alias("x1"), pick("y1", "y0").alias("y1"), F.when(up, 1.0).otherwise(-1.0).alias("sign"))

    edges = F.transform(F.filter("edges", lambda e: e["y0"] != e["y1"]), oriented)
    area = F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + V.edge_area(e, F.col("px"), F.col("py"))))
    # Rounded, as sums in another order differ in the last bits.
    return rows.select("shape", "px", "py", F.floor(F.least(F.round(area, 9), F.lit(1.0)) * 255.5).cast("long").alias("coverage"))


@query(
    "box_filter_scaling",
    """WITH p AS (SELECT o_custkey % 20 AS doc, x.k AS x, y.k AS y, (o_orderkey * 31 + x.k * 7 + y.k * 13) % 256 AS v FROM (SELECT o_custkey % 20 AS o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1), generate_series(0, 16) x(k), generate_series(0, 10) y(k))
    SELECT doc, ((x + 1) * 5 - 1) // 17 AS tx, ((y + 1) * 4 - 1) // 11 AS ty, CAST(least((CAST(sum(v) AS BIGINT) * (8388608 // count(*))) >> 23, 255) AS BIGINT) AS v FROM p GROUP BY 1, 2, 3""",
)
def box_filter_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 20).alias("doc")).agg(F.min("o_orderkey").alias("k"))
    seq = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))
    pixels = docs.withColumn("x", seq(16)).withColumn("y", seq(10)).withColumn("v", (F.col("k") * 31 + F.col("x") * 7 + F.col("y") * 13) % 256)
    return V.box_scaled(pixels, ["doc"], (17, 11), (5, 4))


@query(
    "image_nearest_blit",
    """WITH g AS (SELECT p_partkey AS img, x.k AS x, y.k AS y, (20 + p_size)::DOUBLE AS w, (10 + p_partkey % 30)::DOUBLE AS h FROM part, generate_series(0, 9) x(k), generate_series(0, 9) y(k)),
    u AS (SELECT *, ((x * 5 + 0.5 - 3) * h) / (w * h) AS u, ((y * 4 + 0.5 - 2) * w) / (w * h) AS v FROM g)
    SELECT img, x, y, CAST(floor(u * 16) AS BIGINT) AS sx, CAST(floor((1 - v) * 12 - 1e-12) AS BIGINT) AS sy FROM u WHERE u >= 0 AND u < 1 AND v >= 0 AND v < 1""",
)
def image_nearest_blit(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long")))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("img"), (F.lit(20.0) + F.col("p_size")).alias("w"), (F.lit(10.0) + F.col("p_partkey") % 30).alias("h")).withColumn("x", seq).withColumn("y", seq)
    zero = F.lit(0.0)
    sx, sy = V.source_pixel(F.col("x") * 5, F.col("y") * 4, (F.col("w"), zero, zero, F.col("h"), F.lit(3.0), F.lit(2.0)), 16, 12)
    return rows.select("img", "x", "y", sx.alias("sx"), sy.alias("sy")).where("sx IS NOT NULL")


@query(
    "dash_cuts",
    """WITH s AS (SELECT l_orderkey AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS seg, CAST(l_quantity AS BIGINT) AS length FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem)),
    a AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY path ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 3 AS pos FROM s),
    c AS (SELECT path, seg, CAST(greatest(k * 10 - pos, 0) AS BIGINT) AS a, CAST(least(k * 10 + 6 - pos, length) AS BIGINT) AS b FROM a, LATERAL (SELECT unnest(range(CAST(pos // 10 AS BIGINT), CAST((pos + length) // 10 + 1 AS BIGINT))) AS k) WHERE length > 0)
    SELECT * FROM c WHERE b > a""",
)
def dash_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").distinct()
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    segments = rows.select(F.col("l_orderkey").alias("path"), F.row_number().over(w).cast("long").alias("seg"), F.col("l_quantity").cast("long").alias("length"))
    return V.dash_cuts(segments, ["path"], 6, 4, 3)


CROSSINGS = "x AS (SELECT l_suppkey % 40 AS paint, l_linenumber::BIGINT AS y, row_number() OVER (PARTITION BY l_suppkey % 40, l_linenumber ORDER BY l_orderkey, l_partkey, l_quantity, l_extendedprice) AS seg, l_partkey * 13 % 200 AS lo, l_partkey * 13 % 200 + CAST(l_quantity AS BIGINT) % 4 AS hi, l_orderkey % 3 - 1 AS cnt FROM lineitem)"


@query(
    "merged_crossings",
    f"""WITH RECURSIVE {CROSSINGS}, sim AS (
      SELECT paint, y, seg, [{{'lo': lo, 'hi': hi, 'cnt': cnt}}] AS m FROM x WHERE seg = 1
      UNION ALL SELECT x.paint, x.y, x.seg, CASE WHEN s.m[len(s.m)].hi + 1 >= x.lo AND s.m[len(s.m)].lo <= x.hi + 1
        THEN list_append(s.m[1:len(s.m) - 1], {{'lo': least(s.m[len(s.m)].lo, x.lo), 'hi': greatest(s.m[len(s.m)].hi, x.hi), 'cnt': s.m[len(s.m)].cnt + x.cnt}})
        ELSE list_append(s.m, {{'lo': x.lo, 'hi': x.hi, 'cnt': x.cnt}}) END
      FROM sim s JOIN x ON x.paint = s.paint AND x.y = s.y AND x.seg = s.seg + 1),
    f AS (SELECT paint, y, arg_max(m, seg) AS m FROM sim GROUP BY paint, y)
    SELECT paint, y, CAST(i - 1 AS INTEGER) AS k, m[i].lo AS lo, m[i].hi AS hi, m[i].cnt AS cnt FROM f, LATERAL (SELECT unnest(range(1, len(m) + 1)) AS i)""",
)
def merged_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy(F.col("l_suppkey") % 40, "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice")
    rows = table(spark, sf_dir, "lineitem")
    lo = F.col("l_partkey") * 13 % 200
    x = rows.select((F.col("l_suppkey") % 40).alias("paint"), F.col("l_linenumber").cast("long").alias("y"), F.row_number().over(w).alias("seg"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") % 4).alias("hi"), (F.col("l_orderkey") % 3 - 1).alias("cnt"))
    return V.merged_crossings(x, ["paint"])


POINTS = "p AS (SELECT p_partkey % 300 AS paint, 0 AS sub, CAST(row_number() OVER (PARTITION BY p_partkey % 300 ORDER BY p_partkey) AS BIGINT) AS k, p_partkey * 3 % 17 AS x, p_size % 9 AS y FROM part)"


@query(
    "edge_table",
    f"""WITH {POINTS}, n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM p WINDOW w AS (PARTITION BY paint ORDER BY k)),
    e AS (SELECT paint, k, CASE WHEN y > ny THEN nx ELSE x END AS x0, least(y, ny) AS y0, CASE WHEN y > ny THEN x ELSE nx END AS x1, greatest(y, ny) AS y1, y > ny AS flipped FROM n)
    SELECT paint, k, x0, y0, x1, y1, flipped, y0 = y1 AS horizontal, x0 = x1 AS vertical, CASE WHEN y0 <> y1 THEN CAST(floor((x1 - x0)::DOUBLE / (y1 - y0) * 65536 + 0.5) AS BIGINT) ELSE 0 END AS slope_fp FROM e""",
)
def edge_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.edge_table(points(spark, sf_dir), ["paint"]).drop("sub").select("paint", "k", "x0", "y0", "x1", "y1", "flipped", "horizontal", "vertical", "slope_fp")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("p_partkey")
    w = Window.partitionBy(k % 300).orderBy("p_partkey")
    return table(spark, sf_dir, "part").select((k % 300).alias("paint"), F.lit(0).alias("sub"), F.row_number().over(w).cast("long").alias("k"), (k * 3 % 17).alias("x"), (F.col("p_size") % 9).alias("y"))


@query(
    "clip_rectangles",
    f"""WITH q AS (SELECT o_orderkey AS paint, k, CASE WHEN k IN (0, 3) THEN o_custkey % 9 ELSE o_custkey % 9 + 4 END AS x, CASE WHEN k < 2 THEN 2 ELSE CASE WHEN o_orderkey % 3 = 0 AND k = 2 THEN 9 ELSE 7 END END AS y FROM orders, generate_series(0, 3) g(k)),
    n AS (SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM q WINDOW w AS (PARTITION BY paint ORDER BY k))
    SELECT paint, count(*) = 4 AND count(*) FILTER (x = nx) = 2 AND count(*) FILTER (y = ny) = 2 AS rect, min(x) AS x0, CAST(min(y) AS BIGINT) AS y0, max(x) - 1 AS x1, CAST(max(y) - 1 AS BIGINT) AS y1 FROM n GROUP BY paint""",
)
def clip_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    left = F.col("o_custkey") % 9
    x = F.when(F.col("k").isin(0, 3), left).otherwise(left + 4)
    y = F.when(F.col("k") < 2, 2).when((F.col("o_orderkey") % 3 == 0) & (F.col("k") == 2), 9).otherwise(7)
    corners = rows.select(F.col("o_orderkey").alias("paint"), F.lit(0).alias("sub"), "k", x.alias("x"), y.alias("y"))
    return V.is_rectangle(V.edge_table(corners, ["paint"]), ["paint"])


PIXELS = "px AS (SELECT DISTINCT l_partkey % 64 AS x, l_suppkey % 64 AS y, CAST(l_quantity AS BIGINT) * 5 AS v FROM lineitem)"


def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 64).alias("x"), (F.col("l_suppkey") % 64).alias("y"), (F.col("l_quantity").cast("long") * 5).alias("v")).distinct()


@query(
    "halftone_clustered",
    f"""WITH {PIXELS} SELECT x, y, v, CAST(CASE WHEN v >= greatest(CAST(floor(least(greatest((1 - ((x % 8 - 4) * (x % 8 - 4) + (y % 8 - 4) * (y % 8 - 4)) / 32.0::DOUBLE) * 254 + 0.5, 0.5), 254.5)) AS BIGINT), 1) THEN 255 ELSE 0 END AS BIGINT) AS ink FROM px""",
)
def halftone_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.screened(gray_pixels(spark, sf_dir), V.clustered_screen(spark, 8), 8).select("x", "y", "v", "ink")


@query(
    "halftone_stochastic",
    f"""WITH {PIXELS}, c AS (SELECT x.k AS cx, y.k AS cy FROM generate_series(0, 7) x(k), generate_series(0, 7) y(k)), d AS (SELECT x.k AS dx, y.k AS dy FROM generate_series(0, 7, 4) x(k), generate_series(0, 7, 4) y(k)),
    a AS (SELECT cx, cy, min(pow(least(abs(cx - dx), 8 - abs(cx - dx)), 2) + pow(least(abs(cy - dy), 8 - abs(cy - dy)), 2)) AS away FROM c, d GROUP BY cx, cy),
    t AS (SELECT cx, cy, greatest((row_number() OVER (ORDER BY away, cy, cx) - 1) * 254 // 64, 1) AS threshold FROM a)
    SELECT x, y, v, CAST(CASE WHEN v >= threshold THEN 255 ELSE 0 END AS BIGINT) AS ink FROM px JOIN t ON x % 8 = cx AND y % 8 = cy""",
)
def halftone_stochastic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.screened(gray_pixels(spark, sf_dir), V.stochastic_screen(spark, 8, 2), 8).select("x", "y", "v", "ink")


@query(
    "mesh_free_form",
    """WITH RECURSIVE v AS (SELECT p_partkey % 37 AS mesh, CAST(row_number() OVER (PARTITION BY p_partkey % 37 ORDER BY p_partkey) AS BIGINT) AS seq, p_size % 4 AS flag FROM part),
    sim AS (SELECT mesh, 0::BIGINT AS seq, []::BIGINT[] AS open, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::BIGINT AS c, 0 AS t, false AS made FROM v WHERE seq = 1
      UNION ALL SELECT v.mesh, v.seq,
        CASE WHEN len(s.open) = 2 THEN [] WHEN len(s.open) > 0 OR v.flag = 0 THEN list_append(s.open, v.seq) ELSE s.open END,
        CASE WHEN len(s.open) = 2 THEN s.open[1] WHEN len(s.open) = 1 OR v.flag = 0 OR s.a IS NULL THEN s.a WHEN v.flag = 1 THEN s.b WHEN v.flag = 2 THEN s.c ELSE s.a END,
        CASE WHEN len(s.open) = 2 THEN s.open[2] WHEN len(s.open) = 1 OR v.flag = 0 OR s.a IS NULL THEN s.b WHEN v.flag = 1 THEN s.c WHEN v.flag = 2 THEN s.a ELSE s.b END,
        CASE WHEN len(s.open) = 2 THEN v.seq WHEN len(s.open) = 1 OR v.flag = 0 OR s.a IS NULL THEN s.c WHEN v.flag IN (1, 2) THEN v.seq ELSE s.c END,
        s.t + CASE WHEN s.made THEN 1 ELSE 0 END,
        len(s.open) = 2 OR (len(s.open) = 0 AND v.flag IN (1, 2) AND s.a IS NOT NULL)
      FROM sim s JOIN v ON v.mesh = s.mesh AND v.seq = s.seq + 1)
    SELECT mesh, t, a, b, c FROM sim WHERE made""",
)
def mesh_free_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    k = F.col("p_partkey")
    w = Window.partitionBy(k % 37).orderBy("p_partkey")
    vertices = table(spark, sf_dir, "part").select((k % 37).alias("mesh"), F.row_number().over(w).alias("seq"), (F.col("p_size") % 4).alias("flag"))
    return V.mesh_triangles(vertices, ["mesh"])


@query(
    "lru_budget",
    "SELECT event_id FROM (SELECT event_id, sum(CAST(floor(value) AS BIGINT) + 1) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 500",
)
def lru_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.struct("ts", "event_id").alias("used"), (F.floor("value").cast("long") + 1).alias("bytes"))
    return V.least_recent(rows, ["user_id"], "used", "bytes", F.lit(500)).select("event_id")


@query(
    "cache_tier_bytes",
    "SELECT source AS tier, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, count(*) AS n FROM documents GROUP BY source",
)
def cache_tier_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("tier")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count(F.lit(1)).alias("n"))


@query("mcu_count", "SELECT DISTINCT w, h, sx, sy, ((w + 8 * sx - 1) // (8 * sx)) * ((h + 8 * sy - 1) // (8 * sy)) AS mcus FROM (SELECT l_partkey + 1 AS w, l_suppkey + 1 AS h, l_orderkey % 2 + 1 AS sx, l_partkey % 2 + 1 AS sy FROM lineitem)")
def mcu_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") + 1).alias("w"), (F.col("l_suppkey") + 1).alias("h"), (F.col("l_orderkey") % 2 + 1).alias("sx"), (F.col("l_partkey") % 2 + 1).alias("sy")).distinct()
    blocks = lambda size, step: div(F.col(size) + F.col(step) * 8 - 1, F.col(step) * 8)
    return rows.withColumn("mcus", blocks("w", "sx") * blocks("h", "sy"))


_TABLE = [[(i * 37 + ch * 91) % 256 for ch in range(3)] for i in range(16)]
_CLUT = "px AS (SELECT DISTINCT l_orderkey % 256 AS c, l_partkey % 256 AS m, (l_suppkey * 3) % 256 AS y, (l_orderkey * 7) % 256 AS k FROM lineitem)"


def _clut_sql() -> str:
    """The sixteen corners of a grid of two, each with its weight."""
    out = []
    for ch, name in enumerate("rgb"):
        terms = []
        for i, row in enumerate(_TABLE):
            weight = " * ".join(f"{v} / 255.0::DOUBLE" if i >> (3 - j) & 1 else f"(1 - {v} / 255.0::DOUBLE)" for j, v in enumerate("cmyk"))
            terms.append(f"{row[ch]} * {weight}")
        out.append(f"{' + '.join(terms)} AS {name}")
    return f"WITH {_CLUT} SELECT c, m, y, k, round(r, 0) - r < 0.49 AND r - round(r, 0) < 0.49 AS clear, CASE WHEN round(r, 0) - r < 0.49 AND r - round(r, 0) < 0.49 THEN CAST(round(r, 0) AS BIGINT) ELSE -1 END AS r FROM (SELECT c, m, y, k, {', '.join(out)} FROM px)"


@query("clut_interpolation", _clut_sql())
def clut_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values close to a half are left open: sums in another order round them either way."""
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 256).alias("c"), (F.col("l_partkey") % 256).alias("m"), (F.col("l_suppkey") * 3 % 256).alias("y"), (F.col("l_orderkey") * 7 % 256).alias("k")).distinct()
    c, m, y, k = (F.col(x) for x in "cmyk")
    weights = F.lit(0.0)
    for i, row in enumerate(_TABLE):
        w = F.lit(float(row[0]))
        for j, v in enumerate((c, m, y, k)):
            w = w * (v / F.lit(255.0) if i >> (3 - j) & 1 else 1 - v / F.lit(255.0))
        weights = weights + w
    near = (F.abs(F.round(weights, 0) - weights)) < 0.49
    return rows.select("c", "m", "y", "k", near.alias("clear"), F.when(near, V.clut(c, m, y, k, _TABLE, 2)[0]).otherwise(-1).alias("r"))


@query(
    "coons_interior_points",
    "SELECT p_partkey AS patch, round((-4 * a + 6 * (b + c) - 2 * (d + e) + 3 * (f + g) - h) / 9.0::DOUBLE, 6) AS p11 FROM (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 11 AS b, p_partkey % 13 AS c, p_partkey % 17 AS d, p_partkey % 19 AS e, p_partkey % 23 AS f, p_partkey % 29 AS g, p_partkey % 31 AS h FROM part)",
)
def coons_interior_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda m: (F.col("p_partkey") % m).cast("double")
    grid = [[F.lit(0.0)] * 4 for _ in range(4)]
    grid[0][0], grid[0][1], grid[1][0], grid[0][3], grid[3][0], grid[3][1], grid[1][3], grid[3][3] = (n(m) for m in (7, 11, 13, 17, 19, 23, 29, 31))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("patch"), F.round(coons_interior(grid)[1, 1], 6).alias("p11"))


@query(
    "function_based_grid",
    "SELECT x.k AS i, y.k AS j, CAST(floor(255 * ((x.k + 0.5) / 64) * ((y.k + 0.5) / 64) + 0.5) AS BIGINT) AS r, CAST(floor(255 * (1 - (x.k + 0.5) / 64) + 0.5) AS BIGINT) AS g FROM generate_series(0, 63) x(k), generate_series(0, 63) y(k)",
)
def function_based_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function of two inputs on the 64 x 64 grid at which such shadings are sampled."""
    from quire.functions.color import unit_to_byte
    from quire.functions.pdf_function import calculator

    cells = spark.range(64 * 64).select(div(F.col("id"), 64).alias("i"), (F.col("id") % 64).alias("j"))
    x, y = (F.col("i") + 0.5) / 64, (F.col("j") + 0.5) / 64
    red, green = calculator("{ 1 index exch mul exch 1 exch sub }", [x, y], [(0, 1), (0, 1)])
    return cells.select("i", "j", unit_to_byte(red).alias("r"), unit_to_byte(green).alias("g"))
