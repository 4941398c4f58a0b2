"""Shadings of types 1 to 7 as colours of device pixels."""

from __future__ import annotations

import math

import numpy as np

from quire.drawing.images import Space, space_of
from quire.drawing.numbers import function
from quire.sources.filters import FilterError
from quire.sources.pdf import Document, Stream, as_int

MAX_PATCH_DEPTH, COLOR_STEP = 6, 3 / 255


def numbers(doc: Document, found) -> list[float]:
    return [float(x) for x in (doc.get(v) for v in doc.get(found) or []) if isinstance(x, (int, float))]


def inverse(m: tuple) -> tuple | None:
    a, b, c, d, e, f = m
    det = a * d - b * c
    return None if not det else (d / det, -b / det, -c / det, a / det, (c * f - d * e) / det, (b * e - a * f) / det)


def through(m: tuple, x, y):
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def shade(doc: Document, found, matrix: tuple, width: int, height: int, resources: dict | None) -> tuple[np.ndarray, np.ndarray] | None:
    """((h, w, 3) bytes, (h, w) mask) of a shading under a matrix, or None if it can't be used."""
    found = doc.get(found)
    info = found.info if isinstance(found, Stream) else found
    back = inverse(matrix)
    if not isinstance(info, dict) or back is None:
        return None
    info = {k: doc.get(v) for k, v in info.items()}
    space, kind = space_of(doc, info.get("ColorSpace"), resources), as_int(info.get("ShadingType"))
    color = function(doc, info["Function"]) if "Function" in info else None
    py, px = np.mgrid[0:height, 0:width] + 0.5
    try:
        if kind in (1, 2, 3) and color is not None:
            x, y = through(back, px, py)
            out = (function_based if kind == 1 else axial if kind == 2 else radial)(doc, info, color, x, y)
        elif kind in (4, 5, 6, 7) and isinstance(found, Stream):
            return mesh(doc, found, info, kind, color, space, matrix, width, height)
        else:
            return None
    except (ValueError, IndexError, KeyError, TypeError, FilterError, ZeroDivisionError):
        return None
    values, mask = out
    rgb = np.zeros((height, width, 3), np.uint8)
    if mask.any():
        rgb[mask] = np.clip(space.rgb(values[:, mask].T), 0, 255)
    box = numbers(doc, info.get("BBox"))
    if len(box) == 4:
        mask = mask & (x >= box[0]) & (x <= box[2]) & (y >= box[1]) & (y <= box[3])
    return rgb, mask


def colors_at(color, t: np.ndarray) -> np.ndarray:
    """(components, h, w) of a function of one input, evaluated once a value."""
    distinct, which = np.unique(t, return_inverse=True)
    return color(distinct[None, :])[:, which.reshape(t.shape)]


def function_based(doc, info, color, x, y):
    domain = numbers(doc, info.get("Domain")) or [0.0, 1.0, 0.0, 1.0]
    own = numbers(doc, info.get("Matrix"))
    if len(own) == 6:
        back = inverse(tuple(own))
        if back is None:
            raise ValueError("matrix")
        x, y = through(back, x, y)
    mask = (x >= domain[0]) & (x <= domain[1]) & (y >= domain[2]) & (y <= domain[3])
    return color(np.stack([x.ravel(), y.ravel()])).reshape(-1, *x.shape), mask


def ends(doc, info):
    domain, extend = numbers(doc, info.get("Domain")) or [0.0, 1.0], [doc.get(v) is True for v in info.get("Extend") or [False, False]]
    return domain, extend


def axial(doc, info, color, x, y):
    x0, y0, x1, y1 = numbers(doc, info["Coords"])
    domain, extend = ends(doc, info)
    dx, dy = x1 - x0, y1 - y0
    s = ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)
    mask = ((s >= 0) | extend[0]) & ((s <= 1) | extend[1])
    return colors_at(color, domain[0] + np.clip(s, 0, 1) * (domain[1] - domain[0])), mask


def radial(doc, info, color, x, y):
    """The largest parameter in range whose circle, of a radius not below zero, meets the point."""
    x0, y0, r0, x1, y1, r1 = numbers(doc, info["Coords"])
    domain, extend = ends(doc, info)
    dx, dy, dr = x1 - x0, y1 - y0, r1 - r0
    a = dx * dx + dy * dy - dr * dr
    b, c = (x - x0) * dx + (y - y0) * dy + r0 * dr, (x - x0) ** 2 + (y - y0) ** 2 - r0 * r0
    if abs(a) < 1e-12:
        with np.errstate(divide="ignore", invalid="ignore"):
            roots = [c / (2 * b)]
    else:
        root = np.sqrt(np.maximum(b * b - a * c, 0))
        real = b * b - a * c >= 0
        roots = [np.where(real, v, np.nan) for v in sorted_roots(a, b, root)]
    s, mask = np.zeros_like(x), np.zeros(x.shape, bool)
    for v in roots:
        ok = ~mask & np.isfinite(v) & (r0 + v * dr >= 0) & ((v >= 0) | extend[0]) & ((v <= 1) | extend[1])
        s[ok] = v[ok]
        mask |= ok
    return colors_at(color, domain[0] + np.clip(s, 0, 1) * (domain[1] - domain[0])), mask


def sorted_roots(a, b, root):
    return [(b + root) / a, (b - root) / a] if a > 0 else [(b - root) / a, (b + root) / a]


class Vertices:
    """Bit-packed flags, coordinates and colours of a mesh stream."""

    def __init__(self, doc, stream, info, n_colors):
        self.bits = np.unpackbits(np.frombuffer(doc.decoded(stream), np.uint8))
        self.at, self.n = 0, n_colors
        self.flag_bits, self.xy_bits, self.color_bits = (as_int(info.get(k)) for k in ("BitsPerFlag", "BitsPerCoordinate", "BitsPerComponent"))
        self.decode = numbers(doc, info["Decode"])

    def left(self) -> bool:
        return self.at + self.flag_bits + 2 * self.xy_bits <= len(self.bits)

    def number(self, n: int) -> int:
        if self.at + n > len(self.bits):
            raise IndexError
        out = int("".join(map(str, self.bits[self.at : self.at + n].tolist())) or "0", 2)
        self.at += n
        return out

    def scaled(self, n: int, k: int) -> float:
        low, high = self.decode[2 * k], self.decode[2 * k + 1]
        return low + self.number(n) * (high - low) / ((1 << n) - 1)

    def point(self):
        return self.scaled(self.xy_bits, 0), self.scaled(self.xy_bits, 1)

    def color(self) -> list[float]:
        return [self.scaled(self.color_bits, 2 + k) for k in range(self.n)]

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def mesh(doc, stream, info, kind, color, space: Space, matrix, width, height):
    v = Vertices(doc, stream, info, 1 if color is not None else space.n)
    triangles = (free_form if kind == 4 else lattice if kind == 5 else patches)(v, info, kind)
    values = np.zeros((height, width, v.n))
    mask = np.zeros((height, width), bool)
    for corners in triangles:
        paint_triangle([(*through(matrix, *p), c) for p, c in corners], values, mask)
    rgb = np.zeros((height, width, 3), np.uint8)
    if mask.any():
        flat = values[mask]
        flat = color(flat.T).T if color is not None else flat
        rgb[mask] = np.clip(space.rgb(flat), 0, 255)
    return rgb, mask


def paint_triangle(corners, values, mask) -> None:
    (xa, ya, ca), (xb, yb, cb), (xc, yc, cc) = corners
    area = (xb - xa) * (yc - ya) - (xc - xa) * (yb - ya)
    h, w = mask.shape
    if not area or not math.isfinite(area):
        return
    x0, x1 = max(0, math.floor(min(xa, xb, xc) - 0.5)), min(w, math.ceil(max(xa, xb, xc)) + 1)
    y0, y1 = max(0, math.floor(min(ya, yb, yc) - 0.5)), min(h, math.ceil(max(ya, yb, yc)) + 1)
    if x0 >= x1 or y0 >= y1:
        return
    y, x = np.mgrid[y0:y1, x0:x1] + 0.5
    wa = ((xb - x) * (yc - y) - (xc - x) * (yb - y)) / area
    wb = ((xc - x) * (ya - y) - (xa - x) * (yc - y)) / area
    wc = 1 - wa - wb
    inside = (wa >= -1e-9) & (wb >= -1e-9) & (wc >= -1e-9)
    mixed = wa[..., None] * np.array(ca) + wb[..., None] * np.array(cb) + wc[..., None] * np.array(cc)
    values[y0:y1, x0:x1][inside] = mixed[inside]
    mask[y0:y1, x0:x1] |= inside


def free_form(v: Vertices, info, kind):
    """Flag 0 starts a triangle, 1 keeps its last two corners, 2 its first and last."""
    last: list = []
    while v.left():
        try:
            flag = v.number(v.flag_bits)
            corner = (v.point(), v.color())
            v.align()
            if flag == 0:
                last = [corner]
                for _ in range(2):
                    v.number(v.flag_bits)
                    last.append((v.point(), v.color()))
                    v.align()
            elif flag in (1, 2) and len(last) == 3:
                last = [last[1], last[2], corner] if flag == 1 else [last[0], last[2], corner]
            else:
                continue
        except IndexError:
            return
        yield last


def lattice(v: Vertices, info, kind):
    per_row, above = as_int(info.get("VerticesPerRow")), None
    v.flag_bits = 0
    while per_row >= 2 and v.left():
        try:
            row = []
            for _ in range(per_row):
                row.append((v.point(), v.color()))
                v.align()
        except IndexError:
            return
        for k in range(per_row - 1 if above else 0):
            yield [above[k], above[k + 1], row[k]]
            yield [above[k + 1], row[k + 1], row[k]]
        above = row


#: Places of a patch's control points in the order of the stream: around the edge, then within.
EDGE = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 3), (2, 3), (3, 3), (3, 2), (3, 1), (3, 0), (2, 0), (1, 0)]
INNER = [(1, 1), (1, 2), (2, 2), (2, 1)]
#: By flag: the places of the previous patch that become the first four of this one, and its two colours.
SHARED = {1: (EDGE[3:7], (1, 2)), 2: (EDGE[6:10], (2, 3)), 3: ([*EDGE[9:12], EDGE[0]], (3, 0))}


def patches(v: Vertices, info, kind):
    """Coons (6) and tensor (7) patches, split until their colours hardly change."""
    grid, colors = None, None
    while v.left():
        try:
            flag = v.number(v.flag_bits) & 3
            points, own = {}, []
            if flag and grid is None:
                return
            if flag:
                places, kept = SHARED[flag]
                points = dict(zip(EDGE[:4], [grid[p] for p in places]))
                own = [colors[k] for k in kept]
            for p in [*EDGE[len(points) :], *(INNER if kind == 7 else ())]:
                points[p] = v.point()
            own += [v.color() for _ in range(4 - len(own))]
            v.align()
        except IndexError:
            return
        if kind == 6:
            points |= {p: inner(points, *p) for p in INNER}
        grid, colors = points, own
        yield from split(grid, colors)


def inner(p: dict, i: int, j: int) -> tuple[float, float]:
    """A control point that makes a Coons patch a tensor patch."""
    r, s = 3 * (i > 1), 3 * (j > 1)
    t, u = 3 - r, 3 - s
    return tuple((-4 * p[r, s][k] + 6 * (p[r, j][k] + p[i, s][k]) - 2 * (p[r, u][k] + p[t, s][k]) + 3 * (p[t, j][k] + p[i, u][k]) - p[t, u][k]) / 9 for k in (0, 1))


def bernstein(t: np.ndarray) -> np.ndarray:
    return np.stack([(1 - t) ** 3, 3 * t * (1 - t) ** 2, 3 * t * t * (1 - t), t**3], axis=1)


def split(grid: dict, colors: list):
    """Triangles of the patch on an even grid, as fine as its colours ask for."""
    c = np.array(colors)
    change = max(np.abs(c[a] - c[b]).max() for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)))
    n = 1 << min(MAX_PATCH_DEPTH, max(2, math.ceil(math.log2(max(change / COLOR_STEP, 1)))))
    t = np.linspace(0, 1, n + 1)
    p = np.array([[grid[i, j] for j in range(4)] for i in range(4)])
    where = np.einsum("ai,bj,ijk->abk", bernstein(t), bernstein(t), p)
    u, w = t[:, None, None], t[None, :, None]  # corners: (0,0), (0,3), (3,3), (3,0)
    mixed = (1 - u) * (1 - w) * c[0] + (1 - u) * w * c[1] + u * w * c[2] + u * (1 - w) * c[3]
    corner = lambda a, b: (tuple(where[a, b]), mixed[a, b].tolist())
    for a in range(n):
        for b in range(n):
            yield [corner(a, b), corner(a, b + 1), corner(a + 1, b)]
            yield [corner(a, b + 1), corner(a + 1, b + 1), corner(a + 1, b)]
