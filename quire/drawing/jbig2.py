"""JBIG2 images by arithmetic coding: generic, refinement and text regions, symbol dictionaries.

Bitmaps are lists of rows of 0 and 1; 1 is ink. Regions coded by Huffman tables, and halftones,
fail by name.
"""

from __future__ import annotations

import struct

import numpy as np

#: (Qe, next state after the more, and after the less probable symbol, whether it switches); fixed values.
STATES = [
    (0x5601, 1, 1, 1), (0x3401, 2, 6, 0), (0x1801, 3, 9, 0), (0x0AC1, 4, 12, 0), (0x0521, 5, 29, 0), (0x0221, 38, 33, 0), (0x5601, 7, 6, 1), (0x5401, 8, 14, 0),
    (0x4801, 9, 14, 0), (0x3801, 10, 14, 0), (0x3001, 11, 17, 0), (0x2401, 12, 18, 0), (0x1C01, 13, 20, 0), (0x1601, 29, 21, 0), (0x5601, 15, 14, 1), (0x5401, 16, 14, 0),
    (0x5101, 17, 15, 0), (0x4801, 18, 16, 0), (0x3801, 19, 17, 0), (0x3401, 20, 18, 0), (0x3001, 21, 19, 0), (0x2801, 22, 19, 0), (0x2401, 23, 20, 0), (0x2201, 24, 21, 0),
    (0x1C01, 25, 22, 0), (0x1801, 26, 23, 0), (0x1601, 27, 24, 0), (0x1401, 28, 25, 0), (0x1201, 29, 26, 0), (0x1101, 30, 27, 0), (0x0AC1, 31, 28, 0), (0x09C1, 32, 29, 0),
    (0x08A1, 33, 30, 0), (0x0521, 34, 31, 0), (0x0441, 35, 32, 0), (0x02A1, 36, 33, 0), (0x0221, 37, 34, 0), (0x0141, 38, 35, 0), (0x0111, 39, 36, 0), (0x0085, 40, 37, 0),
    (0x0049, 41, 38, 0), (0x0025, 42, 39, 0), (0x0015, 43, 40, 0), (0x0009, 44, 41, 0), (0x0005, 45, 42, 0), (0x0001, 45, 43, 0), (0x5601, 46, 46, 0),
]
#: Qe by context.
SIZES = [state[0] for state in STATES for _ in (0, 1)]
#: By template: bits of the row itself, of the row above and its reach to the right, of the row
#: above that and its reach; then bit and place of each adaptive pixel, and the context of "like the row above".
TEMPLATES = [
    (4, 7, 3, 5, 2, [(4, 3, -1), (10, -3, -1), (11, 2, -2), (15, -2, -2)], 0x9B25),
    (3, 6, 3, 4, 2, [(3, 3, -1)], 0x0795),
    (2, 5, 2, 3, 1, [(2, 2, -1)], 0x00E5),
    (4, 6, 2, 0, 0, [(4, 2, -1)], 0x0195),
]
#: (bits, offset) of integers, by the length of their prefix.
RANGES = [(2, 0), (4, 4), (6, 20), (8, 84), (12, 340), (32, 4436)]
#: Pixels of a region for each of the page, and of all symbols of a dictionary for each byte of it.
REGION, SYMBOLS = 2, 1 << 12
Bitmap = list[list[int]]


class Jbig2Error(ValueError):
    pass


class Decoder:
    """The arithmetic decoder. A context is an entry of a list: twice the state, plus the likelier bit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.c = self.byte(0) << 16
        self.more()
        self.c <<= 7
        self.left -= 7
        self.a = 0x8000

    def byte(self, at: int) -> int:
        return self.data[at] if at < len(self.data) else 0xFF

    def more(self) -> None:
        if self.byte(self.at) == 0xFF:
            if self.byte(self.at + 1) > 0x8F:
                self.c += 0xFF00
                self.left = 8
                return
            self.at += 1
            self.c += self.byte(self.at) << 9
            self.left = 7
        else:
            self.at += 1
            self.c += self.byte(self.at) << 8
            self.left = 8

    def bit(self, contexts: list[int], k: int) -> int:
        s = contexts[k]
        q, after_more, after_less, switch = STATES[s >> 1]
        d = s & 1
        self.a -= q
        if self.c >> 16 >= q:
            self.c -= q << 16
            if self.a & 0x8000:
                return d
            less = self.a < q
        else:
            less = self.a >= q
            self.a = q
        if less:
            contexts[k] = after_less << 1 | (1 - d if switch else d)
            d = 1 - d
        else:
            contexts[k] = after_more << 1 | d
        while not self.a & 0x8000:
            if not self.left:
                self.more()
            self.a <<= 1
            self.c = self.c << 1 & 0xFFFFFFFF
            self.left -= 1
        return d


class Numbers:
    """Integers and symbol numbers, with contexts for each kind."""

    def __init__(self, decoder: Decoder):
        self.decoder, self.contexts = decoder, {}

    def read(self, kind: str) -> int | None:
        """None is "out of band"."""
        contexts, bit, prev = self.contexts.setdefault(kind, [0] * 512), self.decoder.bit, 1

        def one() -> int:
            nonlocal prev
            d = bit(contexts, prev)
            prev = prev << 1 | d if prev < 256 else (prev << 1 | d) & 511 | 256
            return d

        negative, k = one(), 0
        while k < 5 and one():
            k += 1
        bits, value = RANGES[k][0], 0
        for _ in range(bits):
            value = value << 1 | one()
        value += RANGES[k][1]
        return value if not negative else -value if value else None

    def number(self, kind: str) -> int:
        found = self.read(kind)
        if found is None:
            raise Jbig2Error(f"no value for {kind}")
        return found

    def symbol(self, length: int) -> int:
        contexts, prev = self.contexts.setdefault("ID", [0] * (1 << length + 1)), 1
        for _ in range(length):
            prev = prev << 1 | self.decoder.bit(contexts, prev)
        return prev - (1 << length)


def generic(decoder: Decoder, contexts: list[int], width: int, height: int, template: int, adaptive: list[tuple[int, int]], like_above: bool = False) -> Bitmap:
    own, up, reach, top, top_reach, nominal, same_context = TEMPLATES[template]
    moved = [(bit, dx, dy) for (bit, nx, ny), (dx, dy) in zip(nominal, adaptive) if (dx, dy) != (nx, ny)]
    kept = ~sum(1 << bit for bit, _, _ in moved)
    bit, rows, same = decoder.bit, [], 0
    pad = [0] * (max(reach, top_reach) + 1)
    blank = [0] * width + pad
    own_mask, up_mask, top_mask = (1 << own) - 1, (1 << up) - 1, (1 << top) - 1
    up_shift, quick = own + up, type(decoder) is Decoder
    for y in range(height):
        if like_above:
            same ^= bit(contexts, same_context)
            if same:
                rows.append(list(rows[-1]) if rows else list(blank))
                continue
        above, over, row = rows[y - 1] if y else blank, rows[y - 2] if y > 1 else blank, list(blank)
        rows.append(row)
        a = sum(above[x] << reach - 1 - x for x in range(reach) if x < len(above))
        b = sum(over[x] << top_reach - 1 - x for x in range(top_reach) if x < len(over))
        w = 0
        if quick and not moved:
            interval, code = decoder.a, decoder.c
            for x in range(width):
                a = (a << 1 | above[x + reach]) & up_mask
                b = (b << 1 | over[x + top_reach]) & top_mask
                k = w | a << own | b << up_shift
                s = contexts[k]
                q = SIZES[s]
                if interval - q & 0x8000 and code >> 16 >= q:  # the likelier bit, and the interval stays wide
                    interval -= q
                    code -= q << 16
                    d = s & 1
                else:
                    decoder.a, decoder.c = interval, code
                    d = bit(contexts, k)
                    interval, code = decoder.a, decoder.c
                if d:
                    row[x] = 1
                w = (w << 1 | d) & own_mask
            decoder.a, decoder.c = interval, code
            continue
        for x in range(width):
            a = (a << 1 | above[x + reach]) & up_mask
            b = (b << 1 | over[x + top_reach]) & top_mask
            k = w | a << own | b << up_shift
            if moved:
                k &= kept
                for place, dx, dy in moved:
                    if 0 <= x + dx < width and 0 <= y + dy and rows[y + dy][x + dx]:
                        k |= 1 << place
            d = bit(contexts, k)
            if d:
                row[x] = 1
            w = (w << 1 | d) & own_mask
    return [r[:width] for r in rows]


def refined(decoder: Decoder, contexts: list[int], width: int, height: int, template: int, base: Bitmap, dx: int, dy: int, adaptive: list[tuple[int, int]]) -> Bitmap:
    rows = [[0] * width for _ in range(height)]

    def new(x: int, y: int) -> int:
        return rows[y][x] if 0 <= y < height and 0 <= x < width else 0

    def old(x: int, y: int) -> int:
        x, y = x - dx, y - dy
        return base[y][x] if 0 <= y < len(base) and 0 <= x < len(base[y]) else 0

    for y in range(height):
        for x in range(width):
            if template:
                seen = (new(x - 1, y), new(x + 1, y - 1), new(x, y - 1), new(x - 1, y - 1), old(x + 1, y + 1), old(x, y + 1), old(x + 1, y), old(x, y), old(x - 1, y), old(x, y - 1))
            else:
                (ax, ay), (bx, by) = adaptive
                seen = (
                    new(x - 1, y), new(x + 1, y - 1), new(x, y - 1), new(x + ax, y + ay), old(x + 1, y + 1), old(x, y + 1), old(x - 1, y + 1),
                    old(x + 1, y), old(x, y), old(x - 1, y), old(x + 1, y - 1), old(x, y - 1), old(x + bx, y + by),
                )
            rows[y][x] = decoder.bit(contexts, sum(v << k for k, v in enumerate(seen)))
    return rows


def lay(page: np.ndarray, bitmap: Bitmap, x: int, y: int, operator: int) -> None:
    """0 or, 1 and, 2 xor, 3 xnor, 4 replace."""
    if not bitmap or not bitmap[0]:
        return
    own = np.array(bitmap, np.uint8)
    x0, y0, x1, y1 = max(x, 0), max(y, 0), min(x + own.shape[1], page.shape[1]), min(y + own.shape[0], page.shape[0])
    if x0 >= x1 or y0 >= y1:
        return
    part, own = page[y0:y1, x0:x1], own[y0 - y : y1 - y, x0 - x : x1 - x]
    part[:] = (part | own, part & own, part ^ own, 1 - (part ^ own), own)[min(operator, 4)]


class Fields:
    """Big-endian numbers, one after another."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, form: str):
        (v,) = struct.unpack_from(">" + form, self.data, self.at)
        self.at += struct.calcsize(">" + form)
        return v

    def places(self, n: int) -> list[tuple[int, int]]:
        return [(self.take("b"), self.take("b")) for _ in range(n)]

    def rest(self) -> bytes:
        return self.data[self.at :]


def symbols(data: bytes, known: list[Bitmap]) -> list[Bitmap]:
    f = Fields(data)
    flags = f.take("H")
    if flags & 1:
        raise Jbig2Error("symbols by Huffman tables")
    aggregate, template, fine = flags >> 1 & 1, flags >> 10 & 3, flags >> 12 & 1
    adaptive = f.places(4 if template == 0 else 1)
    near = f.places(2) if aggregate and not fine else []
    n_out, n_new = f.take("I"), f.take("I")
    if n_new > len(data) * 64:
        raise Jbig2Error("too many symbols")
    decoder = Decoder(f.rest())
    numbers, shapes, shades = Numbers(decoder), [0] * (1 << 16), [0] * (1 << 13)
    found, height, room = list(known), 0, SYMBOLS * len(data)
    length = max(1, (len(known) + n_new - 1).bit_length()) if aggregate else 0
    while len(found) < len(known) + n_new:
        height += numbers.number("DH")
        width = 0
        while (step := numbers.read("DW")) is not None:
            width += step
            room -= abs(width * height) + 1
            if width < 0 or height < 0 or room < 0 or len(found) >= len(known) + n_new:
                raise Jbig2Error("size of symbols")
            if not aggregate:
                found.append(generic(decoder, shapes, width, height, template, adaptive))
                continue
            if numbers.number("AI") != 1:
                raise Jbig2Error("symbols of several")
            base = found[numbers.symbol(length)]
            dx, dy = numbers.number("RDX"), numbers.number("RDY")
            found.append(refined(decoder, shades, width, height, fine, base, dx, dy, near))
    out, at, on = [], 0, False
    while at < len(found):
        run = numbers.number("EX")
        if run < 0 or run == 0 and at and not on and not out:
            raise Jbig2Error("runs of symbols")
        out += found[at : at + run] if on else []
        at, on = at + run, not on
    return out[:n_out]


def text(f: Fields, width: int, height: int, known: list[Bitmap]) -> np.ndarray:
    flags = f.take("H")
    if flags & 1:
        raise Jbig2Error("text by Huffman tables")
    fine, strips, corner, turned, operator = flags >> 1 & 1, 1 << (flags >> 2 & 3), flags >> 4 & 3, flags >> 6 & 1, flags >> 7 & 3
    offset = (flags >> 10 & 31) - (32 if flags >> 14 & 1 else 0)
    template = flags >> 15
    near = f.places(2) if fine and not template else []
    n = f.take("I")
    if n > 64 * len(f.data):
        raise Jbig2Error("too many symbols")
    decoder = Decoder(f.rest())
    numbers, shades = Numbers(decoder), [0] * (1 << 13)
    length = max(0, (len(known) - 1).bit_length()) if known else 0
    page = np.full((height, width), flags >> 9 & 1, np.uint8)
    t, first, done = -numbers.number("DT") * strips, 0, 0
    while done < n:
        t += numbers.number("DT") * strips
        first += numbers.number("FS")
        s = first
        while True:
            at = t + (numbers.number("IT") if strips > 1 else 0)
            shape = known[numbers.symbol(length)]
            if fine and numbers.number("RI"):
                dw, dh, dx, dy = (numbers.number(k) for k in ("RDW", "RDH", "RDX", "RDY"))
                w, h = (len(shape[0]) if shape else 0) + dw, len(shape) + dh
                if not (0 <= w <= 2 * width and 0 <= h <= 2 * height):
                    raise Jbig2Error("size of a symbol")
                shape = refined(decoder, shades, w, h, template, shape, (dw >> 1) + dx, (dh >> 1) + dy, near)
            w, h = (len(shape[0]) if shape else 0), len(shape)
            long = (h if turned else w) - 1
            ahead = corner in ((0, 2) if turned else (2, 3))  # the corner is at the far end
            s += long if ahead else 0
            x, y = (at, s) if turned else (s, at)
            lay(page, shape, x - (w - 1 if corner in (2, 3) else 0), y - (h - 1 if corner in (0, 2) else 0), operator)
            s += 0 if ahead else long
            done += 1
            step = numbers.read("DS")
            if step is None or done >= n:
                break
            s += step + offset
    return page


def segments(data: bytes):
    """(number, type, numbers referred to, data)."""
    at = 0
    while at + 11 <= len(data):
        number, flags, count = struct.unpack_from(">IBB", data, at)
        at += 5
        if count >> 5 == 7:
            (count,) = struct.unpack_from(">I", data, at)
            count &= 0x1FFFFFFF
            at += 4 + (count + 8) // 8
        else:
            count >>= 5
            at += 1
        size = 1 if number <= 256 else 2 if number <= 65536 else 4
        if count * size > len(data):
            return
        refers = [int.from_bytes(data[at + k * size : at + (k + 1) * size], "big") for k in range(count)]
        at += count * size + (4 if flags & 0x40 else 1)
        (length,) = struct.unpack_from(">I", data, at)
        at += 4
        length = len(data) - at if length == 0xFFFFFFFF else length
        yield number, flags & 63, refers, data[at : at + length]
        at += length


def decode(data: bytes, shared: bytes, width: int, height: int) -> np.ndarray:
    """(height, width) bits, 0 for ink, of a page and the segments that pages share."""
    page, operator = np.zeros((height, width), np.uint8), 0
    known: dict[int, list[Bitmap]] = {}
    try:
        for number, kind, refers, body in (s for part in (shared, data) for s in segments(part)):
            f = Fields(body)
            if kind == 48:
                page[:] = body[16] >> 2 & 1
            elif kind == 0:
                known[number] = symbols(body, [x for r in refers for x in known.get(r, [])])
            elif kind in (4, 6, 7, 36, 38, 39, 40, 42, 43):
                w, h, x, y, flags = (f.take(c) for c in "IIIIB")
                if w * h > REGION * width * height:
                    raise Jbig2Error("size of a region")
                operator = flags & 7
                if kind < 8:
                    found = text(f, w, h, [b for r in refers for b in known.get(r, [])])
                elif kind < 40:
                    options = f.take("B")
                    if options & 1:
                        from quire.drawing import ccitt

                        found = 1 - ccitt.decode(f.rest(), w, h, -1, False, False)
                    else:
                        template = options >> 1 & 3
                        adaptive = f.places(4 if template == 0 else 1)
                        found = generic(Decoder(f.rest()), bytearray(1 << 16), w, h, template, adaptive, bool(options & 8))
                else:
                    options = f.take("B")
                    if options & 2:
                        raise Jbig2Error("typical prediction of refinements")
                    near = [] if options & 1 else f.places(2)
                    base = page[y : y + h, x : x + w].tolist()
                    found, operator = refined(Decoder(f.rest()), [0] * (1 << 13), w, h, options & 1, base, 0, 0, near), 4
                lay(page, found if isinstance(found, list) else found.tolist(), x, y, operator)
            elif kind in (16, 20, 22, 23):
                raise Jbig2Error("halftones")
    except (struct.error, IndexError, ValueError, OverflowError) as e:
        raise Jbig2Error(f"damaged: {e}") from None
    return 1 - page
