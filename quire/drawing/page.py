"""A page's content run on a bitmap: paths, text, images, shadings, patterns, groups, layers."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass, field, replace

import numpy as np

from quire.drawing import images as I
from quire.drawing import paths as P
from quire.drawing.blending import MODES, composite
from quire.drawing.blending import luma as blend_luma
from quire.drawing.numbers import function
from quire.drawing.shading import inverse, shade, through
from quire.drawing.text import MAX_CHAR_PROC, NO_FONT, Font, resolve_once
from quire.sources.filters import FilterError
from quire.sources.pdf import OPERATORS, Document, Name, Stream, as_int, content_ops

MAX_FORMS, MAX_PATTERNS, MAX_TILE, MAX_UNKNOWN = 32, 4, 4096, 256
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
FILTERS = ("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "FlateDecode", "Raw")
#: Bits of an annotation that is not shown: invisible, hidden, no view.
HIDDEN = 1 | 2 | 32


def product(a, b):
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def to_byte(v: float) -> int:
    return math.floor(min(max(v, 0.0), 1.0) * 255 + 0.5)


def luma(pixels: np.ndarray) -> np.ndarray:
    p = pixels.astype("i4")
    return ((2126 * p[..., 0] + 7152 * p[..., 1] + 722 * p[..., 2] + 5000) // 10000).astype(np.uint8)


@dataclass
class Paint:
    """A colour, or a pattern with the colour below it."""

    rgb: tuple = (0, 0, 0)
    pattern: object = None


@dataclass
class State:
    ctm: tuple = IDENTITY
    fill: Paint = field(default_factory=Paint)
    line: Paint = field(default_factory=Paint)
    fill_space: I.Space = I.GRAY
    line_space: I.Space = I.GRAY
    fill_alpha: int = 255
    line_alpha: int = 255
    blend: str = "Normal"
    soft_mask: np.ndarray | None = None
    width: float = 1.0
    cap: int = 0
    join: int = 0
    miter: float = 10.0
    dash: tuple = ((), 0.0)
    flatness: float = 0.1
    clip: np.ndarray | None = None  # opacity of the clip's pixels
    font: Font | None = None
    size: float = 0.0
    char_space: float = 0.0
    word_space: float = 0.0
    scale: float = 1.0
    leading: float = 0.0
    rise: float = 0.0
    mode: int = 0


@dataclass
class Diagnostics:
    has_images: bool = False
    has_vector_text: bool = False
    filters: dict = field(default_factory=dict)
    max_ppi: float = 0.0
    failed: list = field(default_factory=list)

    def dominant(self) -> str | None:
        """The commonest filter; among equals the last in the list of filters."""
        return max(self.filters, key=lambda f: (self.filters[f], FILTERS.index(f)), default=None)


class OutOfTime(Exception):
    """A page took longer than it may."""


class Page:
    """Draws content operators; y runs down from the page's top. Without ``paints`` nothing is
    drawn and only the diagnostics are gathered."""

    def __init__(self, doc: Document, width: int, height: int, base: tuple, most_ops: int = 50_000_000, antialias: bool = False, paints: bool = True):
        self.doc, self.width, self.height, self.base, self.most_ops, self.antialias, self.paints = doc, width, height, base, most_ops, antialias, paints
        self.pixels = np.full((height, width, 3), 255, np.uint8) if paints else np.zeros((0, 0, 3), np.uint8)
        self.alpha: np.ndarray | None = None
        self.deadline: float | None = None  # of the clock
        self.colored = False  # whether other than plain grays may have been laid
        self.state, self.stack = State(ctm=base), []
        self.paths: list[list] = []
        self.closed: list[bool] = []
        self.pending_clip: bool | None = None
        self.text, self.line = IDENTITY, IDENTITY
        self.text_clip: list | None = None
        self.unknown: set[str] = set()
        self.seen = Diagnostics()
        self.marks: list[bool] = []  # of open marked contents: hidden?
        self.hidden_layers = off_layers(doc)
        self.patterns = 0
        self.glyphs: list[tuple] = []  # (character, x, y, size) in device pixels
        self.uncolored = False

    # Painting.

    def lay(self, patch: P.Patch, color, alpha: int) -> None:
        """``color``: an rgb triple, or an array of them for the patch's pixels."""
        if not self.paints or any(self.marks):
            return
        s, shape, place = self.state, patch.shape, patch.place
        self.colored = self.colored or s.blend != "Normal" or isinstance(color, np.ndarray) or not color[0] == color[1] == color[2]
        if alpha == 255 and isinstance(color, tuple) and s.clip is None and s.soft_mask is None and s.blend == "Normal" and self.alpha is None and not self.antialias:
            pixels = self.pixels[place]  # a plain paint: all or nothing of each pixel
            if shape.all():
                pixels[:] = color
            else:
                pixels[shape > 0] = color
            return
        for other in (s.clip, s.soft_mask):
            if other is not None:
                shape = div255(shape.astype("i4") * other[place])
        if alpha != 255:
            shape = div255(shape.astype("i4") * alpha)
        on = shape > 0
        if not on.any():
            return
        pixels, plane = self.pixels[place], None if self.alpha is None else self.alpha[place]
        colors = color[on] if isinstance(color, np.ndarray) else np.broadcast_to(np.array(color, "i4"), (int(on.sum()), 3))
        if plane is None and s.blend == "Normal" and (shape[on] == 255).all():
            pixels[on] = colors
            return
        mixed, alphas = composite(s.blend, colors, shape[on], pixels[on], None if plane is None else plane[on])
        pixels[on] = mixed
        if alphas is not None:
            plane[on] = alphas

    def paint(self, patch: P.Patch, paint: Paint, alpha: int) -> None:
        if not self.paints or not patch.shape.any():
            return
        if paint.pattern is None:
            self.lay(patch, paint.rgb, alpha)
            return
        found = self.pattern_pixels(paint)
        if found is not None:
            rgb, mask = found
            self.lay(patch._replace(shape=div255(patch.shape.astype("i4") * mask[patch.place])), rgb[patch.place], alpha)

    def shape(self, paths: list, even_odd: bool) -> P.Patch:
        if not self.paints:
            return P.Patch(0, 0, np.zeros((0, 0), np.uint8))
        return P.fill_shape(paths, self.width, self.height, even_odd, self.antialias)

    def finish(self, fill: str | None = None, stroke: bool = False) -> None:
        s = self.state
        if fill and len(self.paths) == 1 and self.paints and not self.antialias and (box := P.rectangle(self.paths[0])):
            self.fill_box(box)
        elif fill and self.paths:
            self.paint(self.shape(self.paths, fill == "eo"), s.fill, s.fill_alpha)
        if stroke and self.paths:
            self.paint(self.stroked(self.paths, self.closed), s.line, s.line_alpha)
        if self.pending_clip is not None:
            self.intersect_clip(self.shape(self.paths, self.pending_clip))
        self.paths, self.closed, self.pending_clip = [], [], None

    def fill_box(self, box: tuple[int, int, int, int]) -> None:
        """Fills whole pixels, ends included."""
        x0, y0, x1, y1 = max(box[0], 0), max(box[1], 0), min(box[2] + 1, self.width), min(box[3] + 1, self.height)
        if x0 >= x1 or y0 >= y1:
            return
        s = self.state
        if s.fill.pattern is None and s.fill_alpha == 255 and s.clip is None and s.soft_mask is None and s.blend == "Normal" and self.alpha is None:
            if not any(self.marks):
                r, g, b = s.fill.rgb
                if r == g == b:
                    self.pixels[y0:y1, x0:x1] = r
                else:
                    self.colored, self.pixels[y0:y1, x0:x1] = True, s.fill.rgb
            return
        self.paint(P.Patch(y0, x0, np.full((y1 - y0, x1 - x0), 255, np.uint8)), s.fill, s.fill_alpha)

    def intersect_clip(self, patch: P.Patch) -> None:
        if self.paints:
            clip, old = np.zeros((self.height, self.width), np.uint8), self.state.clip
            clip[patch.place] = patch.shape if old is None else div255(old[patch.place].astype("i4") * patch.shape)
            self.state.clip = clip

    def stroked(self, paths: list, closed: list) -> P.Patch:
        """Dashes and outlines are made in user space; a line thinner than a pixel gets a pixel."""
        s, polygons, lines = self.state, [], []
        m, back = s.ctm, inverse(s.ctm)
        scale = math.sqrt(abs(m[0] * m[3] - m[1] * m[2]))
        if back is None or not self.paints:
            return P.Patch(0, 0, np.zeros((0, 0), np.uint8))
        thin = s.width * scale < 1
        for points, ring in zip(paths, closed):
            own = points if thin else [through(back, *p) for p in points]
            lengths, phase = [v * (scale if thin else 1) for v in s.dash[0]], s.dash[1] * (scale if thin else 1)
            parts = P.dashed(own, ring, lengths, phase) if lengths else [own]
            if thin and not self.antialias:
                lines += parts if lengths or not ring else [own + own[:1]]
                continue
            for part in parts:
                made = P.outline(part, ring and not lengths, 0.5 if thin else s.width / 2, s.cap, s.join, s.miter)
                polygons += made if thin else [P.positive([through(m, *p) for p in polygon]) for polygon in made]
        return P.hairlines(lines, self.width, self.height) if lines else self.shape(polygons, False)

    # Patterns, groups and forms.

    def layer(self, base: tuple | None = None, width: int | None = None, height: int | None = None) -> Page:
        """An empty transparent page that shares this one's document and findings."""
        out = Page(self.doc, self.width if width is None else width, self.height if height is None else height, base or self.base, self.most_ops, self.antialias, self.paints)
        out.pixels = np.zeros((out.height, out.width, 3), np.uint8)
        out.alpha = np.zeros((out.height, out.width), np.uint8)
        out.deadline = self.deadline
        out.unknown, out.seen, out.patterns, out.glyphs = self.unknown, self.seen, self.patterns, self.glyphs
        return out

    def pattern_pixels(self, paint: Paint) -> tuple[np.ndarray, np.ndarray] | None:
        """(colours, opacity) of the whole page under a pattern."""
        found = paint.pattern
        info = {k: self.doc.get(v) for k, v in (found.info if isinstance(found, Stream) else found).items()}
        matrix = matrix_of(self.doc, info.get("Matrix"))
        whole = product(matrix, self.base)
        if info.get("PatternType") == 2:
            out = shade(self.doc, info.get("Shading"), whole, self.width, self.height, None)
            return None if out is None else (out[0], out[1].astype(np.uint8) * 255)
        box = [float(v) for v in (self.doc.get(x) for x in info.get("BBox") or []) if isinstance(v, (int, float))]
        dx, dy = (float(info.get(k) or 0) for k in ("XStep", "YStep"))
        back = inverse(whole)
        if not isinstance(found, Stream) or len(box) != 4 or not dx or not dy or back is None or self.patterns >= MAX_PATTERNS:
            return None
        sx, sy = math.hypot(whole[0], whole[1]), math.hypot(whole[2], whole[3])
        w, h = (min(max(1, math.ceil(abs(v) * s)), MAX_TILE) for v, s in ((dx, sx), (dy, sy)))
        # The cell is drawn once at the page's scale; parts of the box beyond a step are folded in.
        cell = self.layer((w / abs(dx), 0.0, 0.0, -h / abs(dy), -box[0] * w / abs(dx), h + box[1] * h / abs(dy)), w, h)
        cell.patterns = self.patterns + 1
        cell.state.fill = cell.state.line = Paint(paint.rgb)
        cell.uncolored = as_int(info.get("PaintType")) == 2
        try:
            cell.run(self.doc.decoded(found), info.get("Resources"), 1)
        except FilterError:
            return None
        py, px = np.mgrid[0 : self.height, 0 : self.width] + 0.5
        x, y = through(back, px, py)
        ix = np.floor(np.mod(x - box[0], abs(dx)) / abs(dx) * w).astype("i8").clip(0, w - 1)
        iy = np.floor((1 - np.mod(y - box[1], abs(dy)) / abs(dy)) * h).astype("i8").clip(0, h - 1)
        return cell.pixels[iy, ix], cell.alpha[iy, ix]

    def form(self, found: Stream, resources, depth: int) -> None:
        info = {k: self.doc.get(v) for k, v in found.info.items()}
        if depth >= MAX_FORMS or self.layer_hidden(info.get("OC")):
            return
        kept = self.state, self.text, self.line, self.paths, self.closed
        self.state, self.paths, self.closed = replace(self.state), [], []
        self.state.ctm = product(matrix_of(self.doc, info.get("Matrix")), self.state.ctm)
        self.clip_box(info.get("BBox"))
        try:
            data = self.doc.decoded(found)
            group = info.get("Group")
            s = self.state
            if self.paints and isinstance(group, dict) and group.get("S") == "Transparency" and (s.fill_alpha != 255 or s.blend != "Normal" or s.soft_mask is not None or group.get("I") is True or group.get("K") is True):
                self.group(data, info.get("Resources", resources), depth)
            else:
                self.run(data, info.get("Resources", resources), depth + 1)
        except FilterError:
            pass
        self.state, self.text, self.line, self.paths, self.closed = kept

    def group(self, data: bytes, resources, depth: int) -> None:
        """Content drawn by itself and then laid as one paint."""
        below = self.layer()
        below.state = replace(self.state, fill_alpha=255, line_alpha=255, blend="Normal", soft_mask=None)
        below.run(data, resources, depth + 1)
        self.lay(P.Patch(0, 0, below.alpha), below.pixels, self.state.fill_alpha)

    def clip_box(self, found) -> None:
        box = [float(v) for v in (self.doc.get(x) for x in self.doc.get(found) or []) if isinstance(v, (int, float))]
        if len(box) == 4 and self.paints:
            x0, y0, x1, y1 = box
            corners = [through(self.state.ctm, x, y) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
            self.intersect_clip(P.fill_shape([corners], self.width, self.height, False))

    def mask_from(self, info) -> np.ndarray | None:
        """A soft mask's opacity by pixel, from its group's alpha or luminosity."""
        info = {k: self.doc.get(v) for k, v in info.items()}
        found = info.get("G")
        if not isinstance(found, Stream) or not self.paints:
            return None
        below = self.layer()
        below.state = State(ctm=self.state.ctm)
        luminous = info.get("S") == "Luminosity"
        if luminous:
            space = I.space_of(self.doc, (self.doc.get(found.info.get("Group")) or {}).get("CS"))
            back = [float(v) for v in (self.doc.get(x) for x in info.get("BC") or []) if isinstance(v, (int, float))]
            rgb = space.rgb(np.array([back]))[0] if len(back) == space.n else (0, 0, 0)
            below.pixels[:], below.alpha = np.array(rgb, np.uint8), None
        below.form(Stream({k: v for k, v in found.info.items() if k != "Group"}, found.raw), None, 1)
        out = np.minimum(blend_luma(below.pixels.astype("i4")), 255) if luminous else below.alpha
        transfer = function(self.doc, info["TR"]) if "TR" in info and info["TR"] != "Identity" else None
        if transfer is not None:
            table = np.clip(np.floor(transfer(np.arange(256)[None, :] / 255)[0] * 255 + 0.5), 0, 255)
            out = table[out]
        return out.astype(np.uint8)

    def resource(self, resources, kind: str, name):
        group = self.doc.get((self.doc.get(resources) or {}).get(kind))
        return self.doc.get(group.get(name)) if isinstance(group, dict) and name in group else None

    def layer_hidden(self, ref) -> bool:
        info = self.doc.get(ref)
        if not isinstance(info, dict):
            return False
        groups = self.doc.get(info.get("OCGs")) if info.get("Type") == "OCMD" else None
        members = groups if isinstance(groups, list) else [groups] if groups is not None else [info]
        names = [id(self.doc.get(m)) for m in members]
        hidden = [n in self.hidden_layers for n in names]
        return bool(hidden) and all(hidden)

    # Operators.

    def run(self, data: bytes, resources, depth: int = 0) -> None:
        base, open_marks = len(self.stack), len(self.marks)
        for op in content_ops(data, self.most_ops):
            if self.deadline is not None and time.monotonic() > self.deadline:
                raise OutOfTime
            try:
                k = op.keyword
                if k == "Q" and len(self.stack) <= base:
                    continue
                handler = HANDLERS.get(k)
                if handler is not None:
                    handler(self, k, op.operands, resources, depth)
                elif k not in OPERATORS and len(self.unknown) < MAX_UNKNOWN:
                    self.unknown.add(k)
            except (TypeError, ValueError, IndexError, OverflowError, AttributeError, KeyError):
                continue  # operands of the wrong number or kind: the operator does nothing
        if len(self.stack) > base:
            self.state = self.stack[base]
        del self.stack[base:], self.marks[open_marks:]

    def gsave(self, k, v, resources, depth) -> None:
        if k == "q":
            self.stack.append(replace(self.state))
        elif self.stack:
            self.state = self.stack.pop()

    def concat(self, k, v, resources, depth) -> None:
        self.state.ctm = product(tuple(map(float, v[:6])), self.state.ctm)

    def line_style(self, k, v, resources, depth) -> None:
        s = self.state
        if k == "w":
            s.width = abs(float(v[0]))
        elif k == "J":
            s.cap = int(v[0])
        elif k == "j":
            s.join = int(v[0])
        elif k == "M":
            s.miter = max(float(v[0]), 1.0)
        elif k == "d":
            s.dash = (tuple(float(x) for x in v[0]), float(v[1]))
        elif k == "i":
            s.flatness = max(float(v[0]), 0.1)

    def ext_state(self, k, v, resources, depth) -> None:
        s, info = self.state, {n: self.doc.get(x) for n, x in (self.resource(resources, "ExtGState", v[0]) or {}).items()}
        s.fill_alpha = to_byte(float(info.get("ca", s.fill_alpha / 255)))
        s.line_alpha = to_byte(float(info.get("CA", s.line_alpha / 255)))
        s.width, s.cap, s.join = float(info.get("LW", s.width)), int(info.get("LC", s.cap)), int(info.get("LJ", s.join))
        s.miter, s.flatness = float(info.get("ML", s.miter)), max(float(info.get("FL", s.flatness)), 0.1)
        if "BM" in info:
            names = info["BM"] if isinstance(info["BM"], list) else [info["BM"]]
            s.blend = next((str(n) for n in (self.doc.get(x) for x in names) if n in MODES), "Normal").replace("Compatible", "Normal")
        if isinstance(info.get("D"), list) and len(info["D"]) == 2:
            s.dash = (tuple(float(self.doc.get(x)) for x in self.doc.get(info["D"][0])), float(self.doc.get(info["D"][1])))
        if isinstance(info.get("Font"), list) and len(info["Font"]) == 2:
            s.font, s.size = self.font(info["Font"][0]), float(self.doc.get(info["Font"][1]))
        if "SMask" in info:
            s.soft_mask = self.mask_from(info["SMask"]) if isinstance(info["SMask"], dict) else None

    def point(self, x, y):
        return through(self.state.ctm, float(x), float(y))

    def construct(self, k, v, resources, depth) -> None:
        if k == "m":
            self.paths.append([self.point(v[0], v[1])])
            self.closed.append(False)
        elif k == "re":
            x, y, w, h = map(float, v[:4])
            a, b, c, d, e, f = self.state.ctm
            right, top = x + w, y + h
            self.paths.append([(a * x + c * y + e, b * x + d * y + f), (a * right + c * y + e, b * right + d * y + f), (a * right + c * top + e, b * right + d * top + f), (a * x + c * top + e, b * x + d * top + f)])
            self.closed.append(True)
        elif k == "h":
            self.closed[-1] = True
        else:
            if self.closed[-1]:  # a new subpath from where the closed one began
                self.paths.append([self.paths[-1][0]])
                self.closed.append(False)
            if k == "l":
                self.paths[-1].append(self.point(v[0], v[1]))
                return
            p = [self.point(v[i], v[i + 1]) for i in range(0, len(v) - 1, 2)]
            first = self.paths[-1][-1]
            a, b, c = p if k == "c" else (first, p[0], p[1]) if k == "v" else (p[0], p[1], p[1])
            self.paths[-1] += P.flatten(first, a, b, c, self.state.flatness)

    def paint_path(self, k, v, resources, depth) -> None:
        if k in ("b", "b*", "s") and self.closed:
            self.closed[-1] = True
        self.finish(None if k in "Ssn" else "eo" if k.endswith("*") else "nz", k in ("B", "B*", "b", "b*", "S", "s"))

    def clip_next(self, k, v, resources, depth) -> None:
        self.pending_clip = k == "W*"

    def color(self, k, v, resources, depth) -> None:
        s = self.state
        if self.uncolored:
            return
        if k == "g":
            s.fill, s.fill_space = Paint((to_byte([float(x) for x in v][0]),) * 3 if v else (0, 0, 0)), I.GRAY
            return
        line, low = k[0].isupper(), k.lower()
        space = {"g": I.GRAY, "rg": I.RGB, "k": I.CMYK}.get(low)
        if low == "cs":
            space = I.space_of(self.doc, v[0], self.doc.get(resources))
            values = [1.0] * space.n if space.family in ("Separation", "DeviceN") else [0.0] * 3 + [1.0] if space is I.CMYK else [0.0] * space.n
            paint = Paint(rgb_of(space, values))
        elif low == "scn" and v and isinstance(v[-1], Name):
            space = s.line_space if line else s.fill_space
            below = [float(x) for x in v[:-1]]
            base = space if space.n == len(below) and below else I.BY_COUNT.get(len(below), I.GRAY)
            paint = Paint(rgb_of(base, below) if below else (0, 0, 0), self.resource(resources, "Pattern", v[-1]))
            if paint.pattern is None:
                return
        else:
            values = [float(x) for x in v]
            if space is None:
                space = s.line_space if line else s.fill_space
                if space.n != len(values):
                    space = I.BY_COUNT.get(len(values), I.GRAY)
            paint = Paint(rgb_of(space, values))
            space = space if low in ("g", "rg", "k") else None
        if line:
            s.line, s.line_space = paint, space or s.line_space
        else:
            s.fill, s.fill_space = paint, space or s.fill_space

    def external(self, k, v, resources, depth) -> None:
        found = self.resource(resources, "XObject", v[0])
        if isinstance(found, Stream) and found.info.get("Subtype") == "Image":
            if not self.layer_hidden(found.info.get("OC")):
                self.image(found, resources)
        elif isinstance(found, Stream):
            self.form(found, resources, depth)

    def inline_image(self, k, v, resources, depth) -> None:
        self.image(Stream(v[0], v[1]), resources)

    def image(self, stream: Stream, resources) -> None:
        """Nearest sample of the unit square; images that can't be decoded only count."""
        name = I.name_of_filter(self.doc, stream.info, FILTERS)
        self.seen.has_images = True
        self.seen.filters[name] = self.seen.filters.get(name, 0) + 1
        m, w = self.state.ctm, as_int(self.doc.get(stream.info.get("Width")))
        wide = math.hypot(m[0], m[1])
        if wide:
            self.seen.max_ppi = max(self.seen.max_ppi, w / wide)
        if not self.paints:
            return
        try:
            found = I.resolve(self.doc, stream, self.doc.get(resources))
        except I.ImageError as e:
            self.seen.failed.append(f"{name}: {e.kind}")
            return
        place = I.placed(m, self.width, self.height, found)
        if place is None:
            return
        rows, columns, inside, iy, ix = place
        opacity = found.alpha[iy, ix] if found.alpha is not None else 255
        patch = P.Patch(rows.start, columns.start, np.where(inside, opacity, 0).astype(np.uint8))
        if found.rgb is None:
            self.paint(patch, self.state.fill, self.state.fill_alpha)
        else:
            self.lay(patch, found.rgb[iy, ix], self.state.fill_alpha)

    def shading(self, k, v, resources, depth) -> None:
        if self.paints:
            out = shade(self.doc, self.resource(resources, "Shading", v[0]), self.state.ctm, self.width, self.height, self.doc.get(resources))
            if out is not None:
                self.lay(P.Patch(0, 0, out[1].astype(np.uint8) * 255), out[0], self.state.fill_alpha)

    def marked(self, k, v, resources, depth) -> None:
        if k == "EMC":
            if self.marks:
                self.marks.pop()
        else:
            layer = self.resource(resources, "Properties", v[1]) if k == "BDC" and v[:1] == ["OC"] and isinstance(v[1], Name) else None
            self.marks.append(self.layer_hidden(layer))

    # Text.

    def font(self, ref) -> Font:
        found = self.doc.get(ref)
        return resolve_once(self.doc, found if isinstance(found, dict) else NO_FONT)

    def text_state(self, k, v, resources, depth) -> None:
        s = self.state
        if k == "Tf":
            s.font, s.size = self.font(self.resource(resources, "Font", v[0])), float(v[1])
        elif k == "Tc":
            s.char_space = float(v[0])
        elif k == "Tw":
            s.word_space = float(v[0])
        elif k == "Tz":
            s.scale = float(v[0]) / 100
        elif k == "TL":
            s.leading = float(v[0])
        elif k == "Ts":
            s.rise = float(v[0])
        elif k == "Tr":
            s.mode = int(v[0]) if 0 <= int(v[0]) <= 7 else s.mode

    def text_object(self, k, v, resources, depth) -> None:
        if k == "BT":
            self.text = self.line = IDENTITY
            self.text_clip = []
        else:
            if self.text_clip:
                self.intersect_clip(self.shape(self.text_clip, False))
            self.text_clip = None

    def text_move(self, k, v, resources, depth) -> None:
        s = self.state
        if k == "Tm":
            self.text = self.line = tuple(map(float, v[:6]))
            return
        if k == "TD":
            s.leading = -float(v[1])
        dx, dy = (0.0, -s.leading) if k == "T*" else (float(v[0]), float(v[1]))
        self.text = self.line = product((1.0, 0.0, 0.0, 1.0, dx, dy), self.line)

    def text_show(self, k, v, resources, depth) -> None:
        self.seen.has_vector_text = True
        if k == '"':
            self.state.word_space, self.state.char_space = float(v[0]), float(v[1])
        if k in ("'", '"'):
            self.text_move("T*", [], resources, depth)
        s = self.state
        for part in v[-1] if k == "TJ" else v[-1:]:
            if isinstance(part, bytes):
                self.show(part, resources, depth)
            elif isinstance(part, (int, float)):
                self.text = product((1.0, 0.0, 0.0, 1.0, -part / 1000 * s.size * s.scale, 0.0), self.text)

    def show(self, text: bytes, resources, depth: int) -> None:
        s = self.state
        if s.font is None:
            return
        character = s.font.character
        for code in s.font.codes(text):
            placed = product((s.size * s.scale, 0.0, 0.0, s.size, 0.0, s.rise), product(self.text, s.ctm))
            x, y = through(placed, 0.0, 0.0)
            self.glyphs.append((character(code), x, y, math.hypot(placed[2], placed[3])))
            if s.font.type3 is not None:
                self.char_proc(code, placed, resources, depth)
                width = s.font.widths.get(code, 0.0) * s.font.matrix[0]
            else:
                if self.paints and (s.mode < 7 or self.text_clip is not None):
                    self.glyph(s.font, code, placed)
                width = s.font.width(code) / 1000
            blank = s.word_space if code == 32 and not s.font.two_bytes else 0.0
            self.text = product((1.0, 0.0, 0.0, 1.0, (width * s.size + s.char_space + blank) * s.scale, 0.0), self.text)

    def glyph(self, font: Font, code: int, placed: tuple) -> None:
        """Fills (modes 0, 2, 4, 6), strokes (1, 2, 5, 6) and keeps for the clip (4 to 7)."""
        s, units = self.state, font.face.units if font.face else 1000.0
        paths: list[list] = []
        for kind, points in font.outline(code):
            p = [through(placed, x / units, y / units) for x, y in points]
            if kind == "m" or not paths:
                paths.append([p[-1]])
            elif kind == "l":
                paths[-1] += p
            else:
                paths[-1] += P.flatten(paths[-1][-1], *p)
        if not paths:
            return
        if s.mode in (0, 2, 4, 6):
            self.paint(self.shape(paths, False), s.fill, s.fill_alpha)
        if s.mode in (1, 2, 5, 6):
            self.paint(self.stroked(paths, [True] * len(paths)), s.line, s.line_alpha)
        if s.mode >= 4 and self.text_clip is not None:
            self.text_clip += paths

    def char_proc(self, code: int, placed: tuple, resources, depth: int) -> None:
        font = self.state.font
        found = self.doc.get(font.procs.get(font.names.get(code)))
        if not isinstance(found, Stream) or depth >= MAX_FORMS or self.state.mode == 3:
            return
        kept = self.state, self.text, self.line, self.text_clip, self.uncolored
        self.state = replace(self.state, ctm=product(font.matrix, placed))
        try:
            data = self.doc.decoded(found)
            if len(data) <= MAX_CHAR_PROC:
                self.run(data, font.type3.get("Resources", resources), depth + 1)
        except FilterError:
            pass
        self.state, self.text, self.line, self.text_clip, self.uncolored = kept

    def type3_width(self, k, v, resources, depth) -> None:
        self.uncolored = self.uncolored or k == "d1"

    def annotations(self, page: dict) -> None:
        """Normal appearances, after the page's content."""
        for ref in self.doc.get(page.get("Annots")) or []:
            info = self.doc.get(ref)
            if not isinstance(info, dict) or as_int(self.doc.get(info.get("F"))) & HIDDEN or self.layer_hidden(info.get("OC")):
                continue
            found = self.doc.get((self.doc.get(info.get("AP")) or {}).get("N"))
            if isinstance(found, dict):
                found = self.doc.get(found.get(str(self.doc.get(info.get("AS")))))
            rect = self.doc.box(info.get("Rect"))
            if isinstance(found, Stream) and rect:
                self.appearance(found, rect)

    def appearance(self, found: Stream, rect: tuple) -> None:
        """The box of the appearance, through its matrix, is fitted into the annotation's rectangle."""
        box, matrix = self.doc.box(found.info.get("BBox")) or (0.0, 0.0, 1.0, 1.0), matrix_of(self.doc, found.info.get("Matrix"))
        corners = [through(matrix, x, y) for x in box[::2] for y in box[1::2]]
        x0, y0 = min(p[0] for p in corners), min(p[1] for p in corners)
        w, h = max(p[0] for p in corners) - x0, max(p[1] for p in corners) - y0
        sx, sy = (rect[2] - rect[0]) / w if w else 1.0, (rect[3] - rect[1]) / h if h else 1.0
        self.state, self.stack = State(ctm=product((sx, 0.0, 0.0, sy, rect[0] - x0 * sx, rect[1] - y0 * sy), self.base)), []
        self.form(found, None, 1)


HANDLERS = {
    **dict.fromkeys(("q", "Q"), Page.gsave), "cm": Page.concat, **dict.fromkeys(("w", "J", "j", "M", "d", "i"), Page.line_style), "gs": Page.ext_state,
    **dict.fromkeys(("m", "l", "c", "v", "y", "h", "re"), Page.construct), **dict.fromkeys(("f", "F", "f*", "B", "B*", "b", "b*", "S", "s", "n"), Page.paint_path), **dict.fromkeys(("W", "W*"), Page.clip_next),
    **dict.fromkeys(("g", "G", "rg", "RG", "k", "K", "cs", "CS", "sc", "SC", "scn", "SCN"), Page.color), "Do": Page.external, "BI": Page.inline_image, "sh": Page.shading,
    **dict.fromkeys(("BMC", "BDC", "EMC"), Page.marked), **dict.fromkeys(("Tf", "Tc", "Tw", "Tz", "TL", "Ts", "Tr"), Page.text_state), **dict.fromkeys(("BT", "ET"), Page.text_object),
    **dict.fromkeys(("Td", "TD", "Tm", "T*"), Page.text_move), **dict.fromkeys(("Tj", "TJ", "'", '"'), Page.text_show), **dict.fromkeys(("d0", "d1"), Page.type3_width),
}


def div255(x: np.ndarray) -> np.ndarray:
    return np.minimum((x + (x >> 8) + 128) >> 8, 255)


def rgb_of(space: I.Space, values: list[float]) -> tuple[int, int, int]:
    if not values:
        return 0, 0, 0
    if space is I.GRAY:
        return (to_byte(values[0]),) * 3
    if space is I.RGB and len(values) >= 3:
        return tuple(map(to_byte, values[:3]))
    return tuple(int(c) for c in np.clip(space.rgb(np.array([values], "f8"))[0], 0, 255))


def matrix_of(doc: Document, found) -> tuple:
    values = [doc.get(v) for v in doc.get(found) or []]
    return tuple(map(float, values)) if len(values) == 6 and all(isinstance(v, (int, float)) for v in values) else IDENTITY


def off_layers(doc: Document) -> set[int]:
    """Layers that are switched off and not on, by the identity of their dictionaries."""
    root = doc.get(doc.trailer.get("Root"))
    default = doc.get((doc.get(root.get("OCProperties")) or {}).get("D")) if isinstance(root, dict) else None
    default = default if isinstance(default, dict) else {}
    off, on = ({id(doc.get(r)) for r in doc.get(default.get(k)) or []} for k in ("OFF", "ON"))
    return off - on


def round_half(x: float) -> int:
    return math.floor(x + 0.5)


def base_matrix(geometry: dict, dpi: float) -> tuple:
    """From the page's space to pixels: scale, rotation, origin and a y axis that runs down."""
    unit = geometry["user_unit"]
    scale, turn = dpi / 72 * unit, geometry["rotate_cw"]
    w, h, x, y = geometry["width_pts"] / unit, geometry["height_pts"] / unit, geometry["origin_x"], geometry["origin_y"]
    return {
        90: (0.0, scale, scale, 0.0, -y * scale, -x * scale),
        180: (-scale, 0.0, 0.0, scale, (x + w) * scale, -y * scale),
        270: (0.0, -scale, -scale, 0.0, (y + w) * scale, (x + h) * scale),
    }.get(turn, (scale, 0.0, 0.0, -scale, -x * scale, (y + h) * scale))


def draw(doc: Document, page: dict, own: dict, geometry: dict, dpi: float, antialias: bool = False, annotations: bool = True, paints: bool = True, seconds: float | None = None) -> Page:
    """The page at a resolution, with its diagnostics. Raises OutOfTime after ``seconds``."""
    wide, high = round_half(geometry["width_pts"] * dpi / 72), round_half(geometry["height_pts"] * dpi / 72)
    out = Page(doc, wide, high, base_matrix(geometry, dpi), antialias=antialias, paints=paints)
    out.deadline = None if seconds is None else time.monotonic() + seconds
    out.run(doc.content(page), own.get("Resources"))
    if annotations:
        out.annotations(page)
    return out
