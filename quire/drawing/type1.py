"""Type 1 font programs: the encrypted part, subroutines and Type 1 charstrings."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

from quire.drawing.outlines import MAX_NESTING, Face, FontError, Outline

#: First keys of the encrypted part and of charstrings, and the constants of both (fixed values of the format).
EEXEC_KEY, CHARSTRING_KEY, FACTOR, OFFSET = 55665, 4330, 52845, 22719
NUMBER = rb"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of FACTOR and of what undoes it, modulo 2**64, of which the last 16 bits count."""
    return tuple(np.cumprod(np.concatenate([[1], np.full(n, f)]).astype("u8")) for f in (FACTOR, pow(FACTOR, -1, 1 << 16)))


def decrypted(data: bytes, key: int, skip: int) -> bytes:
    """Each key is the sum of the bytes before it, each times a power of FACTOR."""
    c = np.frombuffer(data, np.uint8)
    most = 1 << max(len(c), 1024).bit_length()
    up, down = (p[: len(c) + 1] for p in powers(most))
    sums = np.cumsum((c * np.uint64(FACTOR) + np.uint64(OFFSET)) * down[1:])
    keys = np.full(len(c), key, "u8")
    keys[1:] += sums[:-1]
    return (c ^ (keys * up[:-1] >> np.uint64(8)).astype(np.uint8)).tobytes()[skip:]


def encrypted(data: bytes, key: int, lead: int = 4) -> bytes:
    out = bytearray()
    for p in bytes(lead) + data:
        c = p ^ key >> 8
        out.append(c)
        key = ((c + key) * FACTOR + OFFSET) & 0xFFFF
    return bytes(out)


def without_segments(data: bytes) -> bytes:
    """The segments of a binary file after one another; other files as they are."""
    out, at = b"", 0
    while data[at : at + 1] == b"\x80" and data[at + 1 : at + 2] in (b"\1", b"\2"):
        size = int.from_bytes(data[at + 2 : at + 6], "little")
        out += data[at + 6 : at + 6 + size]
        at += 6 + size
    return out or data


class Type1(Face):
    def __init__(self, data: bytes):
        super().__init__()
        data = without_segments(data)
        clear, mark, rest = data.partition(b"eexec")
        if not mark:
            raise FontError("no encrypted part")
        rest = rest.lstrip(b" \t\r\n")
        if re.match(rb"[0-9A-Fa-f\s]{8}", rest):
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", rest)
            rest = bytes.fromhex(digits[: len(digits) // 2 * 2].decode())
        private = decrypted(rest, EEXEC_KEY, 4)
        skip = re.search(rb"/lenIV\s+(-?\d+)", private)
        self.skip = int(skip[1]) if skip else 4
        matrix = re.search(rb"/FontMatrix\s*\[\s*(" + NUMBER + rb")", clear)
        if matrix and float(matrix[1]):
            self.units = 1 / float(matrix[1])
        at = private.find(b"/CharStrings")
        self.subroutines = {int(k): code for k, code in self.programs(private[: at if at >= 0 else len(private)], rb"dup\s+(\d+)\s+(\d+)\s+(?:RD|-\||\S+)[ ]")}
        found = list(self.programs(private[at + 12 :], rb"/(\S+)\s+(\d+)\s+(?:RD|-\||\S+)[ ]")) if at >= 0 else []
        if not found:
            raise FontError("no charstrings")
        self.glyphs = [code for _, code in found]
        self.names = {name.decode("latin-1"): g for g, (name, _) in enumerate(found)}
        self.n_glyphs = len(self.glyphs)
        own = re.findall(rb"dup\s+(\d+)\s*/(\S+)\s+put", clear)
        self.codes = {int(c): self.names[n.decode("latin-1")] for c, n in own if n.decode("latin-1") in self.names}

    def programs(self, data: bytes, head: bytes):
        """(name or number, charstring) of each entry; their bytes are jumped over."""
        search, at = re.compile(head).search, 0
        while m := search(data, at):
            end = m.end() + int(m[2])
            yield m[1], data[m.end() : end] if self.skip < 0 else decrypted(data[m.end() : end], CHARSTRING_KEY, self.skip)
            at = end

    def pen(self, gid: int) -> Pen:
        pen = Pen(self)
        if 0 <= gid < self.n_glyphs:
            try:
                pen.run(self.glyphs[gid])
            except (IndexError, ValueError, ZeroDivisionError, OverflowError):
                pass  # as far as it goes
        return pen

    def outline(self, gid: int) -> Outline:
        return self.pen(gid).out

    def advance(self, gid: int) -> float | None:
        return self.pen(gid).width * 1000 / self.units


class Pen:
    """One charstring. ``flex`` collects the points of a flex; ``given`` is what ``pop`` takes."""

    def __init__(self, face: Type1, depth: int = 0):
        self.face, self.depth, self.out = face, depth, []
        self.stack: list[float] = []
        self.given: list[float] = []
        self.x = self.y = self.width = self.bearing = 0.0
        self.flex: list[tuple[float, float]] | None = None
        self.ended = False

    def move(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        if self.flex is None:
            self.out.append(("m", ((self.x, self.y),)))

    def line(self, dx: float, dy: float) -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append(("l", ((self.x, self.y),)))

    def curve(self, a: float, b: float, c: float, d: float, e: float, f: float) -> None:
        p = (self.x + a, self.y + b)
        q = (p[0] + c, p[1] + d)
        self.x, self.y = q[0] + e, q[1] + f
        self.out.append(("c", (p, q, (self.x, self.y))))

    def run(self, code: bytes, depth: int = 0) -> None:
        at = 0
        while at < len(code) and not self.ended:
            b = code[at]
            at += 1
            if b >= 32:
                if b < 247:
                    self.stack.append(float(b - 139))
                elif b < 255:
                    self.stack.append(float((b - 247) * 256 + code[at] + 108 if b < 251 else -(b - 251) * 256 - code[at] - 108))
                    at += 1
                else:
                    self.stack.append(float(int.from_bytes(code[at : at + 4], "big", signed=True)))
                    at += 4
            elif b == 10:
                k = int(self.stack.pop())
                if depth < MAX_NESTING and k in self.face.subroutines:
                    self.run(self.face.subroutines[k], depth + 1)
            elif b == 11:
                return
            elif b == 12:
                self.escaped(code[at])
                at += 1
            else:
                self.operator(b)

    def operator(self, b: int) -> None:
        s = self.stack
        if b == 13:  # hsbw
            self.bearing, self.width = s[0], s[1]
            self.x = s[0]
        elif b == 21:
            self.move(*s[-2:])
        elif b == 22:
            self.move(s[-1], 0)
        elif b == 4:
            self.move(0, s[-1])
        elif b == 5:
            self.line(*s[:2])
        elif b == 6:
            self.line(s[0], 0)
        elif b == 7:
            self.line(0, s[0])
        elif b == 8:
            self.curve(*s[:6])
        elif b == 30:  # vhcurveto
            self.curve(0, s[0], s[1], s[2], s[3], 0)
        elif b == 31:  # hvcurveto
            self.curve(s[0], 0, s[1], s[2], 0, s[3])
        elif b == 14:
            self.ended = True
        self.stack = []  # hints and closepath draw nothing

    def escaped(self, b: int) -> None:
        s = self.stack
        if b == 12:  # div
            d = s.pop()
            s.append(s.pop() / d)
        elif b == 16:  # callothersubr
            k, n = int(s.pop()), int(s.pop())
            taken = [s.pop() for _ in range(n)]
            if k == 1:
                self.flex = []
            elif k == 2 and self.flex is not None:
                self.flex.append((self.x, self.y))
            elif k == 0 and self.flex is not None:
                p = self.flex
                self.flex = None
                if len(p) >= 7:  # the first is a reference point
                    self.out += [("c", tuple(p[1:4])), ("c", tuple(p[4:7]))]
                    self.x, self.y = p[6]
                self.given = taken[:2]
            elif k == 3:
                self.given = [3.0]
            else:
                self.given = taken
        elif b == 17:  # pop
            s.append(self.given.pop() if self.given else 0.0)
        elif b == 33:  # setcurrentpoint
            self.stack = []
        elif b == 7:  # sbw
            self.bearing, self.width = s[0], s[2]
            self.x, self.y = s[0], s[1]
            self.stack = []
        elif b == 6:  # seac: an accented character of the standard encoding
            self.accented(*s[:5])
            self.stack = []
        else:
            self.stack = []

    def accented(self, bearing: float, dx: float, dy: float, base: float, accent: float) -> None:
        from quire.drawing.text import base_encoding

        self.ended = True
        if self.depth:
            return
        for code, x, y in ((base, 0.0, 0.0), (accent, self.bearing - bearing + dx, dy)):
            name = base_encoding("StandardEncoding").get(int(code))
            if name in self.face.names:
                part = Pen(self.face, 1)
                part.run(self.face.glyphs[self.face.names[name]])
                self.out += [(kind, tuple((px + x, py + y) for px, py in points)) for kind, points in part.out]
