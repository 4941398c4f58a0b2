"""Queries of PDF functions and gradients."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import pdf_function as P
from quire.operators import shading as S
from quire.plans.registry import query, table


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 257 / 256.0).cast("double").alias("t"))


T = "WITH e AS (SELECT event_id, (event_id % 257) / 256.0::DOUBLE AS t FROM events) "


@query("function_exponential", T + "SELECT event_id, round(0.1 + pow(t, 1.5::DOUBLE) * 0.8, 6) AS r, round(1.0 - pow(t, 1.5::DOUBLE), 6) AS g FROM e")
def function_exponential(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g = P.exponential(F.col("t"), [0.1, 1.0], [0.9, 0.0], 1.5)
    return inputs(spark, sf_dir).select("event_id", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"))


@query(
    "function_sampled",
    T + "SELECT event_id, round(CASE WHEN t < 1 / 3.0::DOUBLE THEN 51 * t * 3 ELSE CASE WHEN t < 2 / 3.0::DOUBLE THEN 51 + 153 * (t * 3 - 1) ELSE 204 - 204 * (t * 3 - 2) END END / 255.0::DOUBLE, 6) AS v FROM e",
)
def function_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    (v,) = P.sampled(F.col("t"), [[0], [51], [204], [0]], 8)
    return inputs(spark, sf_dir).select("event_id", F.round(v, 6).alias("v"))


@query("function_stitched", T + "SELECT event_id, round(CASE WHEN t < 0.25 THEN t * 4 WHEN t < 0.75 THEN 1 - (t - 0.25) * 2 ELSE pow((t - 0.75) * 4, 2) END, 6) AS v FROM e")
def function_stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    up, square = (lambda t: P.exponential(t, [0.0], [1.0], 1.0)), (lambda t: P.exponential(t, [0.0], [1.0], 2.0))
    (v,) = P.stitched(F.col("t"), [up, up, square], [0.25, 0.75], [(0, 1), (1, 0), (0, 1)])
    return inputs(spark, sf_dir).select("event_id", F.round(v, 6).alias("v"))


@query(
    "function_calculator",
    T + "SELECT event_id, round(CASE WHEN t > 0.5 THEN sqrt(t) ELSE t * t END, 6) AS a, round(abs(sin(radians(t * 360))), 6) AS b, CAST(((CAST(trunc(t * 100) AS BIGINT) & 12) | 1) AS DOUBLE) AS c FROM e",
)
def function_calculator(spark: SparkSession, sf_dir: str) -> DataFrame:
    program = "{ dup dup 0.5 gt { sqrt } { dup mul } ifelse exch dup 360 mul sin abs exch 100 mul cvi 12 and 1 or 4 -1 roll pop }"
    a, b, c = P.calculator("{ dup " + program[1:-1].replace("4 -1 roll pop", "") + " 4 -1 roll pop }", [F.col("t")], [(0, 1), (0, 1), (0, 255)])
    return inputs(spark, sf_dir).select("event_id", F.round(a, 6).alias("a"), F.round(b, 6).alias("b"), c.alias("c"))


XY = "WITH p AS (SELECT DISTINCT (l_partkey % 100)::DOUBLE AS x, (l_suppkey % 100)::DOUBLE AS y FROM lineitem) "


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 100).cast("double").alias("x"), (F.col("l_suppkey") % 100).cast("double").alias("y")).distinct()


@query("shading_axial", XY + "SELECT x, y, round(CASE WHEN t < 0 THEN 0 WHEN t > 1 THEN NULL ELSE t END, 6) AS t FROM (SELECT *, ((x - 10) * 60 + (y - 2) * 30) / 4500.0::DOUBLE AS t FROM p)")
def shading_axial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("x", "y", F.round(S.axial(F.col("x"), F.col("y"), (10, 2), (70, 32), (True, False)), 6).alias("t"))


@query("shading_radial", XY + "SELECT x, y, round(CASE WHEN d >= 5 AND d <= 45 THEN (d - 5) / 40 END, 6) AS t FROM (SELECT *, sqrt((x - 50) * (x - 50) + (y - 5) * (y - 5)) AS d FROM p)")
def shading_radial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("x", "y", F.round(S.radial(F.col("x"), F.col("y"), (50, 5), 5.0, (50, 5), 45.0), 6).alias("t"))


TRI = "SELECT o_orderkey AS id, (o_custkey % 20)::DOUBLE AS x0, (o_orderkey % 17)::DOUBLE AS y0, (o_custkey % 20 + 8)::DOUBLE AS x1, (o_orderkey % 17 + 1)::DOUBLE AS y1, (o_custkey % 20 + 2)::DOUBLE AS x2, (o_orderkey % 17 + 7)::DOUBLE AS y2 FROM orders"


@query(
    "gouraud_triangles",
    f"""WITH t AS ({TRI}), p AS (SELECT *, unnest(range(CAST(x0 AS BIGINT), CAST(x1 AS BIGINT) + 1)) AS px FROM (SELECT *, unnest(range(CAST(y0 AS BIGINT), CAST(y2 AS BIGINT) + 1)) AS py FROM t)),
 w AS (SELECT *, (8 * 7 - 2 * 1)::DOUBLE AS area, px + 0.5::DOUBLE AS x, py + 0.5::DOUBLE AS y FROM p),
 u AS (SELECT *, ((x1 - x) * (y2 - y) - (x2 - x) * (y1 - y)) / area AS w0, ((x2 - x) * (y0 - y) - (x0 - x) * (y2 - y)) / area AS w1 FROM w)
 SELECT id, px, py, round(w0 * 0 + w1 * 100 + (1 - w0 - w1) * 200, 6) AS v FROM u WHERE w0 >= 0 AND w1 >= 0 AND 1 - w0 - w1 >= 0""",
)
def gouraud_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = F.col("o_custkey") % 20, F.col("o_orderkey") % 17
    corners = {"x0": c, "y0": o, "x1": c + 8, "y1": o + 1, "x2": c + 2, "y2": o + 7}
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), *[v.cast("double").alias(k) for k, v in corners.items()], F.lit(0.0).alias("v_0"), F.lit(100.0).alias("v_1"), F.lit(200.0).alias("v_2"))
    return S.triangle_pixels(rows, ["id"], ["v"]).select("id", "px", "py", F.round("v", 6).alias("v"))


@query("lattice_mesh", "SELECT x AS row, y AS col, h AS half, CASE WHEN h = 0 THEN v ELSE n END AS a, CASE WHEN h = 0 THEN n ELSE bn END AS b, bl AS c FROM (SELECT g.x, g.y, g.v, n.v AS n, bl.v AS bl, bn.v AS bn, unnest([0, 1]) AS h FROM g JOIN g n ON n.x = g.x AND n.y = g.y + 1 JOIN g bl ON bl.x = g.x + 1 AND bl.y = g.y JOIN g bn ON bn.x = g.x + 1 AND bn.y = g.y + 1)".replace("SELECT x AS row", "WITH g AS (SELECT n_nationkey // 5 AS x, n_nationkey % 5 AS y, n_regionkey AS v FROM nation) SELECT x AS row", 1))
def lattice_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "nation").select(F.expr("CAST(n_nationkey div 5 AS INT)").alias("row"), (F.col("n_nationkey") % 5).alias("col"), F.col("n_regionkey").alias("v"))
    return S.lattice_triangles(g, [], "row", "col", ["v"]).select("row", "col", "half", F.col("a.v").alias("a"), F.col("b.v").alias("b"), F.col("c.v").alias("c"))
