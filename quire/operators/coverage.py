"""Coverage of pixels by edges, scaling of images, dashes and screens as relations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.color import div, long

SAMPLES = 64


def radical_inverse(n: int, base: int) -> float:
    """Of the Halton sequence: the digits of n behind the point, in reverse."""
    out, scale = 0.0, 1.0
    while n:
        scale /= base
        out += n % base * scale
        n //= base
    return out


def jitter() -> list[tuple[float, float]]:
    return [(radical_inverse(n, 2), radical_inverse(n, 3)) for n in range(1, SAMPLES + 1)]


def winding_at(edges: Column, x: Column, y: Column) -> Column:
    """Winding number of a point by an array of edges (x0, y0, x1, y1): edges that cross the ray to the right."""

    def crossing(e: Column) -> Column:
        # A horizontal edge meets neither condition; the divisor is only kept from being zero.
        at = e["x0"] + (y - e["y0"]) / F.when(e["y1"] == e["y0"], F.lit(1.0)).otherwise(e["y1"] - e["y0"]) * (e["x1"] - e["x0"])
        up, down = (e["y0"] <= y) & (y < e["y1"]), (e["y1"] <= y) & (y < e["y0"])
        return F.when(up & (at >= x), 1).when(down & (at >= x), -1).otherwise(0)

    return F.aggregate(edges, F.lit(0), lambda a, e: a + crossing(e))


def jittered_coverage(edges: Column, px: Column, py: Column, even_odd: bool = False) -> Column:
    """0 to 255 by 64 samples of a pixel."""
    samples = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in jitter()])

    def inside(s: Column) -> Column:
        n = winding_at(edges, px + s["x"], py + s["y"])
        return F.when(n % 2 != 0 if even_odd else n != 0, 1).otherwise(0)

    hits = F.aggregate(samples, F.lit(0), lambda a, s: a + inside(s))
    return F.shiftright(hits * 255 + 32, 6).cast("long")


def jittered_pixels(shapes: DataFrame, width: int, height: int, even_odd: bool = False) -> DataFrame:
    """(shape, px, py, coverage) for all pixels of a width x height grid: :func:`jittered_coverage` for the shapes
    (shape, edges) of a batch together, by the same sums in the same order."""
    kind = shapes.schema["shape"].dataType.simpleString()
    sx, sy = (np.array(v) for v in zip(*jitter()))
    across, down = np.arange(width)[:, None] + sx, np.arange(height)[:, None] + sy
    few = max(1, (1 << 17) // (width * height * SAMPLES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, few):
                part = batch.slice(at, few)
                yield pixels(part.column("shape"), part.column("edges"))

    def pixels(names: pa.Array, lists: pa.Array) -> pa.RecordBatch:
        ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        flat = lists.flatten()
        x0, y0, x1, y1 = (flat.field(flat.type.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("x0", "y0", "x1", "y1"))
        wound = np.zeros((len(names), width, height, SAMPLES), "i4")
        for k in range(int(np.diff(ends).max(initial=0))):  # the k-th edge of each shape that has one
            own = np.flatnonzero(np.diff(ends) > k)
            e = ends[own] + k
            a, b, c, d = (v[e][:, None, None] for v in (x0, y0, x1, y1))
            with np.errstate(all="ignore"):
                x = a + (down - b) / np.where(d == b, 1.0, d - b) * (c - a)
            sign = ((b <= down) & (down < d)).astype("i1") - ((d <= down) & (down < b)).astype("i1")
            wound[own] += (x[:, None] >= across[None, :, None]) * sign[:, None]
        hits = np.count_nonzero(wound & 1 if even_odd else wound, axis=3)
        values = (hits.astype("i8") * 255 + 32 >> 6).ravel()
        px, py = np.meshgrid(np.arange(width, dtype="i4"), np.arange(height, dtype="i4"), indexing="ij")
        own = names.take(pa.array(np.repeat(np.arange(len(names)), width * height)))
        return pa.RecordBatch.from_arrays([own, *(pa.array(np.tile(v.ravel(), len(names))) for v in (px, py)), pa.array(values)], ["shape", "px", "py", "coverage"])

    return shapes.select("shape", "edges").mapInArrow(run, f"shape {kind}, px int, py int, coverage long")


def edge_area(e: Column, px: Column, py: Column) -> Column:
    """Signed area of a pixel to the left of an edge (with y0 < y1 and ``sign``): the length of its y span
    within the row at which it lies at or right of the pixel's left side, the part over the pixel in proportion."""
    slope = (e["x1"] - e["x0"]) / (e["y1"] - e["y0"])
    top, bottom = F.greatest(e["y0"], py), F.least(e["y1"], py + 1)
    length = bottom - top
    a = e["x0"] + (top - e["y0"]) * slope
    b = a + length * slope
    left, right = F.least(a, b), F.greatest(a, b)
    upright = F.when((a + b) / 2 >= px + 0.5, length).otherwise(0.0)
    sloped = length * (right - F.greatest(left, px)) / F.when(right == left, F.lit(1.0)).otherwise(right - left)
    cover = F.when(right <= px, 0.0).when(left >= px + 1, length).when(right - left < 1e-6, upright).otherwise(sloped)
    return F.when(length > 0, e["sign"] * cover).otherwise(0.0)


def analytic_coverage(edges: Column, px: Column, py: Column, even_odd: bool = False) -> Column:
    """0 to 255 from the signed areas of all edges."""
    area = F.abs(F.aggregate(edges, F.lit(0.0), lambda a, e: a + edge_area(e, px, py)))
    if not even_odd:
        return F.floor(F.least(area, F.lit(1.0)) * 255.5).cast("long")
    part = area - F.floor(area)
    return F.least(F.floor(F.when(part > 0.5, 1 - part).otherwise(part) * 2 * 255.5).cast("long"), long(255))


def target_of(x: Column, source: Column | int, target: Column | int) -> Column:
    """The target pixel that takes in source pixel x, where pixel i takes floor(i s/t) up to floor((i+1) s/t)."""
    return div((x + 1) * target - 1, source)


def box_scaled(pixels: DataFrame, keys: list[str], source: tuple[int, int], target: tuple[int, int]) -> DataFrame:
    """(keys, tx, ty, v): sums of the source pixels of a target pixel times a 23-bit reciprocal of
    their number, for targets no larger than the source. Every source pixel has a row."""
    tx, ty = (target_of(F.col(c), s, t) for c, s, t in zip("xy", source, target))
    sums = pixels.groupBy(*keys, tx.alias("tx"), ty.alias("ty")).agg(F.sum("v").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return sums.select(*keys, "tx", "ty", F.least(F.shiftright(F.col("_s") * div(1 << 23, F.col("_n")), 23), long(255)).alias("v"))


def source_pixel(x: Column, y: Column, m: tuple[Column, ...], width: int, height: int) -> tuple[Column, Column]:
    """The source pixel under a device pixel's centre, by the inverse of the image's matrix; null outside."""
    det = m[0] * m[3] - m[1] * m[2]
    px, py = x + 0.5 - m[4], y + 0.5 - m[5]
    u, v = F.try_divide(px * m[3] - py * m[2], det), F.try_divide(py * m[0] - px * m[1], det)
    inside = (u >= 0) & (u < 1) & (v >= 0) & (v < 1)
    return F.when(inside, F.floor(u * width).cast("long")), F.when(inside, F.floor((1 - v) * height - 1e-12).cast("long"))


def dash_cuts(segments: DataFrame, keys: list[str], on: int, off: int, phase: int = 0) -> DataFrame:
    """(keys, seg, a, b): the "on" stretches of each segment, in its own arc length, for a pattern of two
    whole lengths. ``segments`` has seg and length; the pattern runs on over a path's segments."""
    before = Window.partitionBy(*keys).orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    total = on + off
    placed = segments.withColumn("_at", F.coalesce(F.sum("length").over(before), F.lit(0)) + phase)
    first, last = F.floor(F.col("_at") / total), F.floor((F.col("_at") + F.col("length")) / total)
    cut = placed.where("length > 0").withColumn("_k", F.explode(F.sequence(first, last)))
    start, end = F.col("_k") * total - F.col("_at"), F.col("_k") * total + on - F.col("_at")
    return cut.select(*keys, "seg", F.greatest(start, F.lit(0)).cast("long").alias("a"), F.least(end, F.col("length")).cast("long").alias("b")).where("b > a")


def merged_crossings(crossings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, k, lo, hi, cnt): crossings of a row in the order of their segments, where one that overlaps or
    touches the one written last joins it: extents unite and counts add up. Rows are dealt by their keys and
    streamed in order; only the last extent of one is held."""
    names = [*keys, "y"]
    kinds = ", ".join(f"`{k}` {crossings.schema[k].dataType.simpleString()}" for k in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, last, k = None, None, 0
        types = None
        for batch in batches:
            types = types or [batch.schema.field(n).type for n in names] + [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            out = []
            for *own, lo, hi, cnt in zip(*[batch.column(c).to_pylist() for c in (*names, "lo", "hi", "cnt")]):
                if own == row and last[1] + 1 >= lo and last[0] <= hi + 1:
                    last = (min(last[0], lo), max(last[1], hi), last[2] + cnt)
                    continue
                if row is not None:
                    out.append((*row, k, *last))
                row, last, k = own, (lo, hi, cnt), k + 1 if own == row else 0
            if out:
                yield written(out, types)
        if row is not None:
            yield written([(*row, k, *last)], types)

    def written(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [*names, "k", "lo", "hi", "cnt"])

    dealt = crossings.select(*names, "seg", *[F.col(c).cast("long").alias(c) for c in ("lo", "hi", "cnt")]).repartition(*names)
    return dealt.sortWithinPartitions(*names, "seg", "lo", "hi", "cnt").mapInArrow(run, f"{kinds}, k int, lo long, hi long, cnt long")


def edge_table(points: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between neighbouring points of closed subpaths (keys, sub, k, x, y): oriented, with flags and
    slopes in 16.16 (0 for level edges). The last point's edge leads back to the first."""
    ring = Window.partitionBy(*keys, "sub").orderBy("k")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = points.select(*keys, "sub", "k", "x", "y", F.coalesce(F.lead("x").over(ring), F.first("x").over(whole)).alias("nx"), F.coalesce(F.lead("y").over(ring), F.first("y").over(whole)).alias("ny"))
    swap = F.col("y") > F.col("ny")
    pick = lambda a, b: F.when(swap, F.col(b)).otherwise(F.col(a))
    edges = ends.select(*keys, "sub", "k", pick("x", "nx").alias("x0"), pick("y", "ny").alias("y0"), pick("nx", "x").alias("x1"), pick("ny", "y").alias("y1"), swap.alias("flipped"))
    slope = F.try_divide((F.col("x1") - F.col("x0")).cast("double"), (F.col("y1") - F.col("y0")).cast("double"))
    fixed = F.least(F.greatest(F.floor(F.coalesce(slope, F.lit(0.0)) * 65536 + 0.5), F.lit(-(1 << 31))), F.lit((1 << 31) - 1)).cast("long")
    return edges.withColumns({"horizontal": F.col("y0") == F.col("y1"), "vertical": F.col("x0") == F.col("x1"), "slope_fp": fixed})


def is_rectangle(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rect, x0, y0, x1, y1): whether a clip path is four edges, two upright and two level, and its whole pixels."""
    agg = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("vertical").cast("int")).alias("nv"), F.sum(F.col("horizontal").cast("int")).alias("nh"), *[f(F.col(c)).alias(f"{n}{c}") for f, n, c in ((F.min, "lo", "x0"), (F.min, "lo", "x1"), (F.max, "hi", "x0"), (F.max, "hi", "x1"), (F.min, "lo", "y0"), (F.max, "hi", "y1"))])
    return agg.select(*keys, ((F.col("n") == 4) & (F.col("nv") == 2) & (F.col("nh") == 2)).alias("rect"), F.floor(F.least("lox0", "lox1")).cast("long").alias("x0"), F.floor("loy0").cast("long").alias("y0"), (F.ceil(F.greatest("hix0", "hix1")) - 1).cast("long").alias("x1"), (F.ceil("hiy1") - 1).cast("long").alias("y1"))


# Screens: thresholds of a size x size cell as rows (x, y, threshold). Cells are small; their size is checked.

MAX_CELL = 64


def cell(spark, size: int) -> DataFrame:
    if not 2 <= size <= MAX_CELL:
        raise ValueError(f"a cell of {size}")
    return spark.range(size * size).select((F.col("id") % size).alias("x"), div(F.col("id"), size).alias("y"))


def clustered_screen(spark, size: int) -> DataFrame:
    """Dots that grow from the middle of the cell."""
    half = size // 2
    distance = ((F.col("x") - half) * (F.col("x") - half) + (F.col("y") - half) * (F.col("y") - half)).cast("double")
    level = F.least(F.greatest((1 - distance / float(2 * half * half)) * 254 + 0.5, F.lit(0.5)), F.lit(254.5))
    return cell(spark, size).withColumn("threshold", F.greatest(F.floor(level).cast("long"), long(1)))


def stochastic_screen(spark, size: int, radius: int) -> DataFrame:
    """Pixels in the order of their distance, around the torus, to the nearest of a grid of dots; ties by place."""
    step = max(2 * radius, 1)
    away = F.lit(None).cast("long")
    for cx in range(0, size, step):
        for cy in range(0, size, step):
            dx, dy = F.abs(F.col("x") - cx), F.abs(F.col("y") - cy)
            dx, dy = F.least(dx, size - dx), F.least(dy, size - dy)
            away = F.least(away, dx * dx + dy * dy)
    n = size * size
    rank = F.row_number().over(Window.orderBy("away", "y", "x")) - 1  # at most MAX_CELL squared rows
    return cell(spark, size).withColumn("away", away).withColumn("rank", rank).select("x", "y", F.greatest(div(F.col("rank") * 254, n), long(1)).alias("threshold"))


def screened(pixels: DataFrame, screen: DataFrame, size: int, value: str = "v") -> DataFrame:
    """Adds ``ink``: 255 where the value reaches the threshold of its place in the cell, else 0."""
    own = F.broadcast(screen.select(F.col("x").alias("_sx"), F.col("y").alias("_sy"), "threshold"))  # MAX_CELL squared rows at most
    on = (F.pmod(pixels["x"], F.lit(size)) == F.col("_sx")) & (F.pmod(pixels["y"], F.lit(size)) == F.col("_sy"))
    return pixels.join(own, on).withColumn("ink", F.when(F.col(value) >= F.col("threshold"), long(255)).otherwise(long(0))).drop("_sx", "_sy", "threshold")


def mesh_triangles(vertices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, t, a, b, c): triangles of a free-form mesh of vertices (keys, seq, flag), as the seq of their
    corners. Flag 0 begins a triangle with the two vertices after it; 1 goes on from the last two corners, 2 from
    the first and last; other flags, and 1 and 2 without a triangle before, are skipped.
    Meshes are dealt by their keys and streamed in order; only the last triangle of one is held."""
    kinds = ", ".join(f"`{k}` {vertices.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mesh, opened, last, t = None, [], None, 0
        for batch in batches:
            out = []
            for *own, v, flag in zip(*[batch.column(c).to_pylist() for c in (*keys, "seq", "flag")]):
                if own != mesh:
                    mesh, opened, last, t = own, [], None, 0
                if opened or flag == 0:  # the corners of a triangle that flag 0 has begun
                    opened.append(v)
                    if len(opened) < 3:
                        continue
                    last, opened = tuple(opened), []
                elif last and flag in (1, 2):
                    last = (last[1], last[2], v) if flag == 1 else (last[2], last[0], v)
                else:
                    continue
                out.append((*own, t, *last))
                t += 1
            if out:
                types = [*(batch.schema.field(k).type for k in keys), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), types)], [*keys, "t", "a", "b", "c"])

    dealt = vertices.select(*keys, F.col("seq").cast("long").alias("seq"), F.col("flag").cast("int").alias("flag")).repartition(*keys)
    return dealt.sortWithinPartitions(*keys, "seq", "flag").mapInArrow(run, f"{kinds}, t int, a long, b long, c long")


def least_recent(entries: DataFrame, keys: list[str], used: str, size: str, budget: Column) -> DataFrame:
    """Entries that a cache of ``budget`` bytes keeps: the most recently used, as long as all from the newest on fit."""
    w = Window.partitionBy(*keys).orderBy(F.col(used).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def clut(c: Column, m: Column, y: Column, k: Column, table: list[list[int]], grid: int) -> list[Column]:
    """Colours of CMYK bytes by linear interpolation in a grid**4 table, whose rows run over c, m, y and then k fastest."""
    if len(table) != grid**4 or grid > 5:
        raise ValueError(f"{len(table)} rows of a grid of {grid}")
    low, part = [], []
    for v in (c, m, y, k):
        at = v * (grid - 1) / F.lit(255.0)
        i = F.least(F.floor(at), F.lit(grid - 2)).cast("int")
        low.append(i)
        part.append(at - i)
    out = []
    for channel in range(len(table[0])):
        values = F.array(*[F.lit(float(row[channel])) for row in table])

        def node(a: int, b: int, d: int, e: int, values=values) -> Column:
            at = ((low[0] + a) * grid + low[1] + b) * grid + low[2] + d
            return F.get(values, at * grid + low[3] + e)

        mix = lambda p, a, b: a + (b - a) * p
        edge = lambda a, b, d: mix(part[3], node(a, b, d, 0), node(a, b, d, 1))
        face = lambda a, b: mix(part[2], edge(a, b, 0), edge(a, b, 1))
        out.append(F.floor(mix(part[0], mix(part[1], face(0, 0), face(0, 1)), mix(part[1], face(1, 0), face(1, 1))) + 0.5).cast("long"))
    return out
