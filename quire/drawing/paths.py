"""Paths: curves to points, dashes, outlines of strokes, scan conversion with and without
antialiasing."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

Point = tuple[float, float]
#: Opacity for 0 to 16 covered samples of a pixel.
COVERAGE = np.array([0, 4, 11, 21, 32, 45, 59, 74, 90, 108, 126, 145, 166, 187, 209, 231, 255], np.uint8)
MAX_SPLITS = 10
MAX_DASHES = 100_000
BUTT, ROUND_CAP, SQUARE = 0, 1, 2
MITER, ROUND_JOIN, BEVEL = 0, 1, 2


def flatten(p0: Point, p1: Point, p2: Point, p3: Point, flatness: float = 0.1, depth: int = MAX_SPLITS) -> list[Point]:
    """Points of a cubic after p0, halved until its controls are near the chord's middle."""
    mx, my = (p0[0] + p3[0]) / 2, (p0[1] + p3[1]) / 2
    if depth == 0 or all((p[0] - mx) ** 2 + (p[1] - my) ** 2 <= flatness**2 for p in (p1, p2)):
        return [p3]
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    a, b, c = mid(p0, p1), mid(p1, p2), mid(p2, p3)
    d, e = mid(a, b), mid(b, c)
    m = mid(d, e)
    return flatten(p0, a, d, m, flatness, depth - 1) + flatten(m, e, c, p3, flatness, depth - 1)


def crossings(paths: list[list[Point]], height: int) -> dict[int, list[list[int]]]:
    """Row -> entries [lo, hi, count] in the order of the segments; an entry that touches
    the one written last is merged into it."""
    rows: dict[int, list[list[int]]] = {}

    def add(y: int, lo: int, hi: int, count: int) -> None:
        entries = rows.setdefault(y, [])
        if entries and entries[-1][1] + 1 >= lo and entries[-1][0] <= hi + 1:
            last = entries[-1]
            last[0], last[1], last[2] = min(last[0], lo), max(last[1], hi), last[2] + count
        else:
            entries.append([lo, hi, count])

    for points in paths:
        for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
            if not all(map(math.isfinite, (xa, ya, xb, yb))):
                continue
            if ya == yb:
                y = math.floor(ya)
                if 0 <= y < height:
                    add(y, math.floor(min(xa, xb)), math.floor(max(xa, xb)), 0)
                continue
            x0, y0, x1, y1, count = (xb, yb, xa, ya, 1) if ya > yb else (xa, ya, xb, yb, -1)
            slope, low, high = (x1 - x0) / (y1 - y0), min(x0, x1), max(x0, x1)
            for y in range(max(math.floor(y0), 0), min(math.floor(y1), height - 1) + 1):
                a, b = (min(max(x0 + (t - y0) * slope, low), high) for t in (y, y + 1))
                add(y, math.floor(min(a, b)), math.floor(max(a, b)), count if y0 < y else 0)
    return rows


def rectangle(points: list[Point]) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1): the pixels, ends included, that the scan conversion below fills for an upright
    rectangle whose first side is level; None for other paths and for slim rectangles."""
    if len(points) != 4:
        return None
    (xa, ya), (xb, yb), (xc, yc), (xd, yd) = points
    if ya != yb or xb != xc or yc != yd or xd != xa or not math.isfinite(xa + ya + xb + yc):
        return None
    x0, x1, y0, y1 = math.floor(xa), math.floor(xb), math.floor(ya), math.floor(yc)
    x0, x1, y0, y1 = (x0, x1, y0, y1) if x0 <= x1 and y0 <= y1 else (min(x0, x1), max(x0, x1), min(y0, y1), max(y0, y1))
    return (x0, y0 + 1, x1, y1 - 1) if x1 - x0 > 1 and y1 > y0 else None


def fill_mask(paths: list[list[Point]], width: int, height: int, even_odd: bool) -> np.ndarray:
    mask = np.zeros((height, width), bool)
    simple = rectangle(paths[0]) if len(paths) == 1 else None
    if simple:
        x0, y0, x1, y1 = simple
        mask[max(y0, 0) : max(y1 + 1, 0), max(x0, 0) : max(x1 + 1, 0)] = True
        return mask
    for y, entries in crossings(paths, height).items():
        entries = sorted(entries, key=lambda e: e[0])
        count, i = 0, 0
        inside = lambda c: bool(c & 1) if even_odd else c != 0
        while i < len(entries):
            start, end, was = entries[i][0], entries[i][1], inside(count)
            count += entries[i][2]
            i += 1
            if not inside(count) and not was:
                continue
            while inside(count) and i < len(entries):
                end = max(end, entries[i][1])
                count += entries[i][2]
                i += 1
            mask[y, max(start, 0) : max(min(end + 1, width), 0)] = True
    return mask


class Patch(NamedTuple):
    """Opacity (0 to 255) of a rectangle of pixels from (y, x) on."""

    y: int
    x: int
    shape: np.ndarray

    @property
    def place(self) -> tuple[slice, slice]:
        h, w = self.shape.shape
        return slice(self.y, self.y + h), slice(self.x, self.x + w)


def bounds(paths: list[list[Point]], width: int, height: int) -> tuple[int, int, int, int]:
    """(x0, y0, x1, y1) of the page's pixels that paths can touch."""
    points = [p for points in paths for p in points if math.isfinite(p[0]) and math.isfinite(p[1])]
    if not points:
        return 0, 0, 0, 0
    xs, ys = zip(*points)
    low = lambda v: max(0, math.floor(min(v)))
    return low(xs), low(ys), max(low(xs), min(width, math.floor(max(xs)) + 1)), max(low(ys), min(height, math.floor(max(ys)) + 1))


def fill_shape(paths: list[list[Point]], width: int, height: int, even_odd: bool, antialias: bool = False) -> Patch:
    """Opacity of the pixels within paths; with antialiasing, of 4 x 4 samples through a gamma table."""
    x0, y0, x1, y1 = bounds(paths, width, height)
    w, h = x1 - x0, y1 - y0
    if not w or not h:
        return Patch(y0, x0, np.zeros((h, w), np.uint8))
    if not antialias:
        moved = [[(x - x0, y - y0) for x, y in points] for points in paths]
        return Patch(y0, x0, fill_mask(moved, w, h, even_odd).astype(np.uint8) * 255)
    fine = [[(4 * (x - x0), 4 * (y - y0)) for x, y in points] for points in paths]
    mask = fill_mask(fine, 4 * w, 4 * h, even_odd)
    return Patch(y0, x0, COVERAGE[mask.reshape(h, 4, w, 4).sum(axis=(1, 3))])


def dashed(points: list[Point], closed: bool, lengths: list[float], phase: float) -> list[list[Point]]:
    """The "on" stretches of a path. The pattern starts anew with each subpath; points that
    all coincide give one stretch without length."""
    total = sum(lengths)
    if not lengths or total <= 0 or min(lengths) < 0:
        return [points + points[:1] if closed else points]
    line = points + points[:1] if closed else points
    if all(p == line[0] for p in line):
        return [[line[0], line[0]]]
    phase -= math.floor(phase / total) * total
    k = 0
    while phase >= lengths[k % len(lengths)]:
        phase -= lengths[k % len(lengths)]
        k += 1
    rest, on = lengths[k % len(lengths)] - phase, k % 2 == 0
    out, own = [], [line[0]] if on else []
    for (xa, ya), (xb, yb) in zip(line, line[1:]):
        length, done = math.hypot(xb - xa, yb - ya), 0.0
        while length - done > rest:
            done += rest
            at = (xa + (xb - xa) * done / length, ya + (yb - ya) * done / length)
            if on:
                out.append([*own, at])
                own = []
            else:
                own = [at]
            on, k = not on, k + 1
            rest = lengths[k % len(lengths)]
            if len(out) > MAX_DASHES:
                return out
        rest -= length - done
        if on:
            own.append((xb, yb))
    if on and len(own) > 1:
        out.append(own)
    return out


def hairlines(paths: list[list[Point]], width: int, height: int) -> Patch:
    """Opacity of lines one pixel wide: a pixel for each step along the longer axis."""
    x0, y0, x1, y1 = bounds(paths, width, height)
    out = np.zeros((y1 - y0, x1 - x0), np.uint8)
    for points in paths:
        for (xa, ya), (xb, yb) in zip(points, points[1:]):
            if not all(map(math.isfinite, (xa, ya, xb, yb))):
                continue
            n = int(min(max(abs(xb - xa), abs(yb - ya)), 1 << 17)) + 1
            t = np.arange(n + 1) / n
            x, y = np.floor(xa + (xb - xa) * t).astype("i8") - x0, np.floor(ya + (yb - ya) * t).astype("i8") - y0
            inside = (x >= 0) & (x < x1 - x0) & (y >= 0) & (y < y1 - y0)
            out[y[inside], x[inside]] = 255
    return Patch(y0, x0, out)


def circle(center: Point, radius: float, steps: int = 24) -> list[Point]:
    return [(center[0] + radius * math.cos(2 * math.pi * k / steps), center[1] + radius * math.sin(2 * math.pi * k / steps)) for k in range(steps)]


def positive(polygon: list[Point]) -> list[Point]:
    area = sum(xa * yb - xb * ya for (xa, ya), (xb, yb) in zip(polygon, polygon[1:] + polygon[:1]))
    return polygon if area >= 0 else polygon[::-1]


def outline(points: list[Point], closed: bool, half: float, cap: int = BUTT, join: int = MITER, miter_limit: float = 10.0) -> list[list[Point]]:
    """Polygons, all wound alike, whose union is the stroke: a box a segment, joins and caps."""
    line = [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]
    if closed and len(line) > 1 and line[0] == line[-1]:
        line.pop()
    if len(line) < 2:
        if not line or cap == BUTT:
            return []
        x, y = line[0]
        return [circle(line[0], half)] if cap == ROUND_CAP else [[(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half)]]
    ring = line + line[:1] if closed else line
    directions = []
    out = []
    for (xa, ya), (xb, yb) in zip(ring, ring[1:]):
        length = math.hypot(xb - xa, yb - ya)
        ux, uy = (xb - xa) / length, (yb - ya) / length
        directions.append((ux, uy))
        nx, ny = -uy * half, ux * half
        out.append([(xa + nx, ya + ny), (xb + nx, yb + ny), (xb - nx, yb - ny), (xa - nx, ya - ny)])
    corners = range(len(directions)) if closed else range(1, len(directions))
    for k in corners:
        (ux, uy), (vx, vy), (x, y) = directions[k - 1], directions[k], ring[k]
        turn = ux * vy - uy * vx
        if join == ROUND_JOIN:
            out.append(circle((x, y), half))
            continue
        side = -1.0 if turn > 0 else 1.0  # the outer side of the corner
        a = (x - uy * half * side, y + ux * half * side)
        b = (x - vy * half * side, y + vx * half * side)
        out.append([(x, y), a, b])
        cosine = ux * vx + uy * vy
        sharp = (1 + cosine) / 2  # square of the sine of half the inner angle
        if join == MITER and sharp > 1e-9 and 1 / sharp <= miter_limit**2 and abs(turn) > 1e-9:
            reach = half / math.sqrt(sharp)
            mx, my = a[0] + b[0] - 2 * x, a[1] + b[1] - 2 * y
            norm = math.hypot(mx, my)
            if norm:
                out.append([(x, y), a, (x + mx / norm * reach, y + my / norm * reach), b])
    if not closed and cap != BUTT:
        for (x, y), (ux, uy) in ((ring[0], (-directions[0][0], -directions[0][1])), (ring[-1], directions[-1])):
            if cap == ROUND_CAP:
                out.append(circle((x, y), half))
            else:
                nx, ny = -uy * half, ux * half
                out.append([(x + nx, y + ny), (x + nx + ux * half, y + ny + uy * half), (x - nx + ux * half, y - ny + uy * half), (x - nx, y - ny)])
    return [positive(p) for p in out]
