"""Gradients, triangles and meshes as relations of pixels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def axial(x: Column, y: Column, start: Sequence[float], end: Sequence[float], extend: tuple[bool, bool] = (False, False)) -> Column:
    """Where (x, y) lies between two points, 0 to 1; null outside unless extended."""
    dx, dy = end[0] - start[0], end[1] - start[1]
    t = ((x - start[0]) * dx + (y - start[1]) * dy) / float(dx * dx + dy * dy)
    return F.when(t < 0, F.lit(0.0) if extend[0] else F.lit(None)).when(t > 1, F.lit(1.0) if extend[1] else F.lit(None)).otherwise(t)


def radial(x: Column, y: Column, c0: Sequence[float], r0: float, c1: Sequence[float], r1: float, extend: tuple[bool, bool] = (False, False)) -> Column:
    """The largest s in range whose circle, of a radius not below zero, passes (x, y)."""
    dx, dy, dr = c1[0] - c0[0], c1[1] - c0[1], r1 - r0
    a = float(dx * dx + dy * dy - dr * dr)
    px, py = x - c0[0], y - c0[1]
    b = px * dx + py * dy + r0 * dr
    c = px * px + py * py - r0 * r0
    if a == 0:
        roots = [F.try_divide(c, 2 * b)]
    else:
        root = F.when(b * b - a * c >= 0, F.sqrt(F.greatest(b * b - a * c, F.lit(0.0))))
        roots = [(b + root) / a, (b - root) / a] if a > 0 else [(b - root) / a, (b + root) / a]

    def allowed(s: Column) -> Column:
        ok = (r0 + s * dr >= 0) & (s >= (-1e30 if extend[0] else 0.0)) & (s <= (1e30 if extend[1] else 1.0))
        return F.when(ok, F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))

    return F.coalesce(*[allowed(s) for s in roots])


def triangle_pixels(triangles: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Pixel centres in triangles (keys, x0..x2, y0..y2, value_0.._2) with values in
    proportion: one row per scanline pixel of a triangle's own box."""
    xs, ys = [F.col(f"x{i}") for i in range(3)], [F.col(f"y{i}") for i in range(3)]
    area = (xs[1] - xs[0]) * (ys[2] - ys[0]) - (xs[2] - xs[0]) * (ys[1] - ys[0])
    rows = triangles.withColumn("_area", area).where("_area <> 0").withColumn("py", F.explode(F.sequence(F.floor(F.least(*ys)), F.floor(F.greatest(*ys)))))
    rows = rows.withColumn("px", F.explode(F.sequence(F.floor(F.least(*xs)), F.floor(F.greatest(*xs)))))
    x, y = F.col("px") + 0.5, F.col("py") + 0.5

    def weight(i: int, j: int) -> Column:
        return ((xs[i] - x) * (ys[j] - y) - (xs[j] - x) * (ys[i] - y)) / F.col("_area")

    weighed = rows.withColumns({"_w0": weight(1, 2), "_w1": weight(2, 0)}).withColumn("_w2", 1 - F.col("_w0") - F.col("_w1")).where("_w0 >= 0 AND _w1 >= 0 AND _w2 >= 0")
    return weighed.select(*keys, "px", "py", *[sum((F.col(f"_w{i}") * F.col(f"{v}_{i}") for i in range(1, 3)), F.col("_w0") * F.col(f"{v}_0")).alias(v) for v in values])


def lattice_triangles(vertices: DataFrame, keys: list[str], row: str, col: str, fields: list[str]) -> DataFrame:
    """Two triangles for each cell of a mesh of rows and columns, by neighbours in windows."""
    along = Window.partitionBy(*keys, row).orderBy(col)
    v = vertices.withColumn("_here", F.struct(*fields)).withColumn("_next", F.lead("_here").over(along))
    down = Window.partitionBy(*keys, col).orderBy(row)
    v = v.withColumn("_below", F.lead("_here").over(down)).withColumn("_belownext", F.lead("_next").over(down)).where("_next IS NOT NULL AND _below IS NOT NULL AND _belownext IS NOT NULL")
    pair = F.array(F.struct(F.lit(0).alias("half"), F.col("_here").alias("a"), F.col("_next").alias("b"), F.col("_below").alias("c")), F.struct(F.lit(1).alias("half"), F.col("_next").alias("a"), F.col("_belownext").alias("b"), F.col("_below").alias("c")))
    return v.select(*keys, row, col, F.explode(pair).alias("t")).select(*keys, row, col, "t.*")


def coons_interior(p: list[list[Column]]) -> dict[tuple[int, int], Column]:
    """The four inner control points of a patch from its twelve outer ones."""
    out = {}
    for i, j in ((1, 1), (1, 2), (2, 1), (2, 2)):
        r, s = 3 * (i > 1), 3 * (j > 1)
        t, u = 3 - r, 3 - s
        out[i, j] = (-4 * p[r][s] + 6 * (p[r][j] + p[i][s]) - 2 * (p[r][u] + p[t][s]) + 3 * (p[t][j] + p[i][u]) - p[t][u]) / 9
    return out
