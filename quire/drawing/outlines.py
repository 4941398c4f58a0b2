"""Glyph outlines of TrueType and CFF font programs, in units of the em square."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

Point = tuple[float, float]
#: ("m" | "l" | "c", points): moves, lines and cubics.
Outline = list[tuple[str, tuple[Point, ...]]]
MAX_NESTING = 10


class FontError(ValueError):
    pass


@dataclass
class Face:
    """``outline(gid)``, ``gid_of(unicode)`` and ``by_name``; advances in thousandths."""

    units: float = 1000.0
    characters: dict[int, int] = field(default_factory=dict)  # Unicode -> glyph
    codes: dict[int, int] = field(default_factory=dict)  # code of a symbol or Roman table -> glyph
    names: dict[str, int] = field(default_factory=dict)
    cids: dict[int, int] = field(default_factory=dict)
    n_glyphs: int = 0

    def outline(self, gid: int) -> Outline:
        raise NotImplementedError

    def advance(self, gid: int) -> float | None:
        return None


def open_face(data: bytes) -> Face:
    if data[:4] in (b"\0\1\0\0", b"true", b"ttcf"):
        return TrueType(data)
    if data[:4] == b"OTTO":
        tables = directory(data, 0)
        return Cff(tables["CFF "])
    if data[:1] == b"\1":
        return Cff(data)
    if data[:2] in (b"%!", b"\x80\1"):
        from quire.drawing.type1 import Type1

        return Type1(data)
    raise FontError("unknown font program")


def directory(data: bytes, at: int) -> dict[str, bytes]:
    n = struct.unpack_from(">H", data, at + 4)[0]
    out = {}
    for k in range(n):
        tag, _, offset, length = struct.unpack_from(">4sIII", data, at + 12 + 16 * k)
        out[tag.decode("latin-1")] = data[offset : offset + length]
    return out


class TrueType(Face):
    def __init__(self, data: bytes):
        super().__init__()
        try:
            at = struct.unpack_from(">I", data, 12)[0] if data[:4] == b"ttcf" else 0
            self.tables = directory(data, at)
            head = self.tables["head"]
            self.units = float(struct.unpack_from(">H", head, 18)[0] or 1000)
            self.n_glyphs = struct.unpack_from(">H", self.tables["maxp"], 4)[0]
            loca, wide = self.tables["loca"], struct.unpack_from(">h", head, 50)[0]
            n = min(self.n_glyphs + 1, len(loca) // (4 if wide else 2))
            self.places = list(struct.unpack_from(f">{n}I", loca)) if wide else [2 * x for x in struct.unpack_from(f">{n}H", loca)]
            self.read_cmap(self.tables.get("cmap", b""))
            self.n_metrics = struct.unpack_from(">H", self.tables["hhea"], 34)[0] if "hhea" in self.tables else 0
        except (struct.error, KeyError) as e:
            raise FontError(str(e)) from None

    def advance(self, gid: int) -> float | None:
        table = self.tables.get("hmtx", b"")
        k = min(gid, self.n_metrics - 1)
        return struct.unpack_from(">H", table, 4 * k)[0] * 1000 / self.units if 0 <= 4 * k < len(table) - 1 else None

    def read_cmap(self, table: bytes) -> None:
        if len(table) < 4:
            return
        for k in range(struct.unpack_from(">H", table, 2)[0]):
            platform, encoding, offset = struct.unpack_from(">HHI", table, 4 + 8 * k)
            found = dict(character_map(table, offset))
            if (platform, encoding) in ((3, 1), (3, 10), (0, 3), (0, 4), (0, 1), (0, 0)):
                self.characters |= found
            elif (platform, encoding) in ((3, 0), (1, 0)):
                self.codes |= {c & 0xFF: g for c, g in found.items()}

    def outline(self, gid: int, depth: int = 0) -> Outline:
        if not 0 <= gid < len(self.places) - 1 or depth > MAX_NESTING:
            return []
        data = self.tables.get("glyf", b"")[self.places[gid] : self.places[gid + 1]]
        try:
            if len(data) < 10:
                return []
            n = struct.unpack_from(">h", data)[0]
            return simple_glyph(data, n) if n >= 0 else self.composite(data, depth)
        except (struct.error, IndexError):
            return []

    def composite(self, data: bytes, depth: int) -> Outline:
        out, at, more = [], 10, True
        while more:
            flags, gid = struct.unpack_from(">HH", data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", data, at)
            at += 4 if flags & 1 else 2
            a, b, c, d = 1.0, 0.0, 0.0, 1.0
            if flags & 8:
                a = d = struct.unpack_from(">h", data, at)[0] / 16384
                at += 2
            elif flags & 0x40:
                a, d = (v / 16384 for v in struct.unpack_from(">hh", data, at))
                at += 4
            elif flags & 0x80:
                a, b, c, d = (v / 16384 for v in struct.unpack_from(">hhhh", data, at))
                at += 8
            if not flags & 2:
                dx = dy = 0  # placed by points: not supported, drawn in place
            out += [(k, tuple((x * a + y * c + dx, x * b + y * d + dy) for x, y in p)) for k, p in self.outline(gid, depth + 1)]
            more = bool(flags & 0x20)
        return out


def character_map(table: bytes, at: int):
    kind = struct.unpack_from(">H", table, at)[0]
    if kind == 0:
        yield from ((c, g) for c, g in enumerate(table[at + 6 : at + 262]) if g)
    elif kind == 4:
        n = struct.unpack_from(">H", table, at + 6)[0] // 2
        ends = struct.unpack_from(f">{n}H", table, at + 14)
        starts = struct.unpack_from(f">{n}H", table, at + 16 + 2 * n)
        deltas = struct.unpack_from(f">{n}H", table, at + 16 + 4 * n)
        places = at + 16 + 6 * n
        offsets = struct.unpack_from(f">{n}H", table, places)
        for k in range(n):
            for c in range(starts[k], ends[k] + 1):
                if c == 0xFFFF:
                    continue
                if offsets[k] == 0:
                    g = (c + deltas[k]) & 0xFFFF
                else:
                    p = places + 2 * k + offsets[k] + 2 * (c - starts[k])
                    g = struct.unpack_from(">H", table, p)[0] if p + 2 <= len(table) else 0
                    g = (g + deltas[k]) & 0xFFFF if g else 0
                if g:
                    yield c, g
    elif kind == 6:
        first, n = struct.unpack_from(">HH", table, at + 6)
        yield from ((first + k, g) for k, g in enumerate(struct.unpack_from(f">{n}H", table, at + 10)) if g)
    elif kind == 12:
        for k in range(min(struct.unpack_from(">I", table, at + 12)[0], 1 << 16)):
            start, end, g = struct.unpack_from(">III", table, at + 16 + 12 * k)
            yield from ((c, g + c - start) for c in range(start, min(end, start + 0xFFFF) + 1))


def simple_glyph(data: bytes, n: int) -> Outline:
    ends = struct.unpack_from(f">{n}H", data, 10) if n else ()
    if not ends:
        return []
    at = 10 + 2 * n
    at += 2 + struct.unpack_from(">H", data, at)[0]
    count, flags = ends[-1] + 1, []
    while len(flags) < count:
        f = data[at]
        at += 1
        flags.append(f)
        if f & 8:
            flags += [f] * data[at]
            at += 1
    axes = []
    for short, same in ((2, 16), (4, 32)):
        v, values = 0, []
        for f in flags[:count]:
            if f & short:
                v += data[at] if f & same else -data[at]
                at += 1
            elif not f & same:
                v += struct.unpack_from(">h", data, at)[0]
                at += 2
            values.append(float(v))
        axes.append(values)
    points = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags)]
    out, start = [], 0
    for end in ends:
        out += contour(points[start : end + 1])
        start = end + 1
    return out


def contour(points: list[tuple[float, float, bool]]) -> Outline:
    """Quadratics with implied points between neighbouring controls, as cubics."""
    if len(points) < 2:
        return []
    full = []
    for k, (x, y, on) in enumerate(points):
        px, py, before = points[k - 1]
        if not on and not before:
            full.append(((px + x) / 2, (py + y) / 2, True))
        full.append((x, y, on))
    first = next((k for k, p in enumerate(full) if p[2]), 0)
    full = full[first:] + full[:first]
    here = full[0][:2]
    out: Outline = [("m", (here,))]
    k = 1
    while k <= len(full):
        x, y, on = full[k % len(full)]
        if on:
            out.append(("l", ((x, y),)))
            here = (x, y)
            k += 1
        else:
            ex, ey, _ = full[(k + 1) % len(full)]
            out.append(("c", (((here[0] + 2 * x) / 3, (here[1] + 2 * y) / 3), ((ex + 2 * x) / 3, (ey + 2 * y) / 3), (ex, ey))))
            here = (ex, ey)
            k += 2
    return out


# CFF: Type 2 charstrings.


def index(data: bytes, at: int) -> tuple[list[bytes], int]:
    n = struct.unpack_from(">H", data, at)[0]
    if not n:
        return [], at + 2
    size = data[at + 2]
    places = [int.from_bytes(data[at + 3 + k * size : at + 3 + (k + 1) * size], "big") for k in range(n + 1)]
    base = at + 2 + (n + 1) * size
    return [data[base + a : base + b] for a, b in zip(places, places[1:])], base + places[-1]


def dictionary(data: bytes) -> dict[int, list[float]]:
    out, held, at = {}, [], 0
    while at < len(data):
        b = data[at]
        at += 1
        if b <= 21:
            if b == 12:
                b = 1200 + data[at]
                at += 1
            out[b], held = held, []
        elif b == 28:
            held.append(float(struct.unpack_from(">h", data, at)[0]))
            at += 2
        elif b == 29:
            held.append(float(struct.unpack_from(">i", data, at)[0]))
            at += 4
        elif b == 30:
            text = ""
            while "f" not in text and at < len(data):
                text += f"{data[at]:02x}"
                at += 1
            held.append(float(text.split("f")[0].replace("a", ".").replace("b", "E").replace("c", "E-").replace("e", "-") or 0))
        elif b < 247:
            held.append(float(b - 139))
        else:
            held.append(float((b - 247) * 256 + data[at] + 108 if b < 251 else -(b - 251) * 256 - data[at] - 108))
            at += 1
    return out


class Cff(Face):
    def __init__(self, data: bytes):
        super().__init__()
        try:
            _, at = index(data, data[2])
            tops, at = index(data, at)
            strings, at = index(data, at)
            self.globals, _ = index(data, at)
            top = dictionary(tops[0])
            self.glyphs, _ = index(data, int(top[17][0]))
            self.n_glyphs = len(self.glyphs)
            matrix = top.get(1207)
            self.units = 1 / matrix[0] if matrix and matrix[0] else 1000.0
            self.by_glyph = None
            if 1236 in top:
                parts, _ = index(data, int(top[1236][0]))
                self.locals = [self.subroutines(data, dictionary(p)) for p in parts]
                self.by_glyph = list(selection(data, int(top[1237][0]), self.n_glyphs))
            else:
                self.locals = [self.subroutines(data, top)]
            charset = list(glyph_names(data, int(top.get(15, [0.0])[0]), self.n_glyphs))
            if 1230 in top:
                self.cids = {c: g for g, c in enumerate(charset)}
            else:
                self.names = {strings[s - 391].decode("latin-1"): g for g, s in enumerate(charset) if 391 <= s < 391 + len(strings)}
                self.names |= {STANDARD_NAMES[s]: g for g, s in enumerate(charset) if s in STANDARD_NAMES}
        except (struct.error, KeyError, IndexError, ValueError) as e:
            raise FontError(str(e)) from None

    @staticmethod
    def subroutines(data: bytes, top: dict) -> list[bytes]:
        if 18 not in top:
            return []
        size, at = map(int, top[18])
        private = dictionary(data[at : at + size])
        return index(data, at + int(private[19][0]))[0] if 19 in private else []

    def outline(self, gid: int) -> Outline:
        if not 0 <= gid < self.n_glyphs:
            return []
        part = self.by_glyph[gid] if self.by_glyph and gid < len(self.by_glyph) else 0
        pen = Charstring(self.locals[part] if part < len(self.locals) else [], self.globals)
        try:
            pen.run(self.glyphs[gid])
        except (IndexError, struct.error):
            pass
        return pen.out


def selection(data: bytes, at: int, n: int):
    if data[at] == 0:
        yield from data[at + 1 : at + 1 + n]
        return
    count = struct.unpack_from(">H", data, at + 1)[0]
    for k in range(count):
        first, part = struct.unpack_from(">HB", data, at + 3 + 3 * k)
        yield from [part] * (struct.unpack_from(">H", data, at + 6 + 3 * k)[0] - first)


def glyph_names(data: bytes, at: int, n: int):
    """String numbers (or CIDs) of the glyphs. Predefined charsets count up from zero."""
    if at <= 2:
        yield from range(n)
        return
    yield 0
    kind, at, done = data[at], at + 1, 1
    while done < n:
        first = struct.unpack_from(">H", data, at)[0]
        left = 0 if kind == 0 else data[at + 2] if kind == 1 else struct.unpack_from(">H", data, at + 2)[0]
        at += 2 + kind
        for k in range(min(left + 1, n - done)):
            yield first + k
        done += left + 1


class Charstring:
    def __init__(self, own: list[bytes], shared: list[bytes]):
        self.own, self.shared = own, shared
        self.stack: list[float] = []
        self.out: Outline = []
        self.x = self.y = 0.0
        self.hints, self.first, self.ended = 0, True, False

    def move(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append(("m", ((self.x, self.y),)))

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append(("l", ((self.x, self.y),)))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        p = (self.x + a, self.y + b)
        q = (p[0] + c, p[1] + d)
        self.x, self.y = q[0] + e, q[1] + f
        self.out.append(("c", (p, q, (self.x, self.y))))

    def width(self, most: int) -> None:
        """The first operator may have the glyph's width before its operands."""
        if self.first and len(self.stack) > most:
            self.stack.pop(0)
        self.first = False

    def run(self, code: bytes, depth: int = 0) -> None:
        at = 0
        while at < len(code) and not self.ended:
            b = code[at]
            at += 1
            if b == 28:
                self.stack.append(float(struct.unpack_from(">h", code, at)[0]))
                at += 2
            elif b >= 32:
                if b < 247:
                    self.stack.append(float(b - 139))
                elif b < 255:
                    self.stack.append(float((b - 247) * 256 + code[at] + 108 if b < 251 else -(b - 251) * 256 - code[at] - 108))
                    at += 1
                else:
                    self.stack.append(struct.unpack_from(">i", code, at)[0] / 65536)
                    at += 4
            elif b in (10, 29):
                table = self.own if b == 10 else self.shared
                k = int(self.stack.pop()) + (107 if len(table) < 1240 else 1131 if len(table) < 33900 else 32768)
                if depth < MAX_NESTING and 0 <= k < len(table):
                    self.run(table[k], depth + 1)
            elif b == 11:
                return
            elif b in (19, 20):
                self.width(len(self.stack) // 2 * 2)
                self.hints += len(self.stack) // 2
                self.stack = []
                at += (self.hints + 7) // 8
            else:
                at = self.operator(1200 + code[at] if b == 12 else b, at + (b == 12))

    def operator(self, b: int, at: int) -> int:
        if b in (1, 3, 18, 23):
            self.width(len(self.stack) // 2 * 2)
            self.hints += len(self.stack) // 2
        elif b == 21:
            self.width(2)
            self.move(*self.stack[-2:])
        elif b == 22:
            self.width(1)
            self.move(self.stack[-1], 0)
        elif b == 4:
            self.width(1)
            self.move(0, self.stack[-1])
        elif b == 14:
            self.ended = True
        else:
            self.draw(b, self.stack)
        self.stack = []
        return at

    def draw(self, b: int, s: list[float]) -> None:
        if b == 5:
            for k in range(0, len(s) - 1, 2):
                self.line(s[k], s[k + 1])
        elif b in (6, 7):
            for k, v in enumerate(s):
                self.line(*((v, 0.0) if (k % 2 == 0) == (b == 6) else (0.0, v)))
        elif b in (8, 24):
            n = len(s) // 6 * 6
            for k in range(0, n, 6):
                self.curve(*s[k : k + 6])
            if b == 24:
                self.line(*s[n : n + 2])
        elif b == 25:
            n = len(s) - 6
            for k in range(0, n - 1, 2):
                self.line(s[k], s[k + 1])
            self.curve(*s[n:])
        elif b in (26, 27):
            extra = s.pop(0) if len(s) % 4 else 0.0
            for k in range(0, len(s) - 3, 4):
                a, c, d, f = s[k : k + 4]
                self.curve(*((extra, a, c, d, 0.0, f) if b == 26 else (a, extra, c, d, f, 0.0)))
                extra = 0.0
        elif b in (30, 31):
            flat = b == 31
            for k in range(0, len(s) - 3, 4):
                a, c, d, f = s[k : k + 4]
                last = s[k + 4] if len(s) - k == 5 else 0.0
                self.curve(*((a, 0.0, c, d, last, f) if flat else (0.0, a, c, d, f, last)))
                flat = not flat
        elif b == 1235:
            self.curve(*s[:6])
            self.curve(*s[6:12])
        elif b == 1234:
            self.curve(s[0], 0, s[1], s[2], s[3], 0)
            self.curve(s[4], 0, s[5], -s[2], s[6], 0)
        elif b == 1236:
            self.curve(s[0], s[1], s[2], s[3], s[4], 0)
            self.curve(s[5], 0, s[6], s[7], s[8], -(s[1] + s[3] + s[7]))
        elif b == 1237:
            dx, dy = s[0] + s[2] + s[4] + s[6] + s[8], s[1] + s[3] + s[5] + s[7] + s[9]
            self.curve(*s[:6])
            self.curve(*s[6:10], *((s[10], -dy) if abs(dx) > abs(dy) else (-dx, s[10])))


# Names of the first standard strings of CFF, in their order from 1.
STANDARD_NAMES = dict(enumerate("""space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash
zero one two three four five six seven eight nine colon semicolon less equal greater question at A B C D E F G H I J K L M N O P Q R S T U V W X Y Z
bracketleft backslash bracketright asciicircum underscore quoteleft a b c d e f g h i j k l m n o p q r s t u v w x y z braceleft bar braceright asciitilde""".split(), 1))
