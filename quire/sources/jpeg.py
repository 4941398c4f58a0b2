"""Baseline and progressive JPEG in NumPy: markers, Huffman tables, DC chains, inverse DCT, upsampling.

The bits of a scan are read serially; everything after the coefficients is vectorised.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_K = np.arange(8)
COSINES = np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.5), 1.0) / 2
FRAMES = {0xC0: "baseline", 0xC1: "extended", 0xC2: "progressive", 0xC3: "lossless"}


class JpegError(ValueError):
    pass


@dataclass
class Component:
    key: int
    h: int
    v: int
    table: int
    dc: int = 0
    ac: int = 0
    blocks: np.ndarray | None = None


@dataclass
class Header:
    kind: str = ""
    width: int = 0
    height: int = 0
    components: list[Component] = field(default_factory=list)
    restart: int = 0
    adobe: int | None = None
    quant: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], list] = field(default_factory=dict)
    scan_at: int = 0
    scan: list[Component] = field(default_factory=list)
    #: First and last coefficient of the scan, and its bits done before and left.
    band: tuple[int, int, int, int] = (0, 63, 0, 0)


def lookup(counts: bytes, symbols: bytes) -> list:
    """(length, symbol) by the next 16 bits; length 0 where no code is."""
    table, code, at = [(0, 0)] * 65536, 0, 0
    for length in range(1, 17):
        for _ in range(counts[length - 1]):
            first = code << (16 - length)
            if at >= len(symbols) or first + (1 << (16 - length)) > 65536:
                raise JpegError("bad Huffman table")
            table[first : first + (1 << (16 - length))] = [(length, symbols[at])] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return table


def read_header(data: bytes, to_scan: bool = True) -> Header:
    """Up to the first scan; with ``to_scan`` false, up to the frame."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("no SOI")
    out = Header()
    read_segments(data, 2, out, to_scan)
    if not out.components:
        raise JpegError("no frame")
    return out


def read_segments(data: bytes, at: int, out: Header, to_scan: bool = True) -> bool:
    """Takes in the segments from ``at`` on; true at a scan, whose data begin at ``scan_at``."""
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if marker in (0xFF, 0x00, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        if marker == 0xD9:
            break
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            out.kind = FRAMES.get(marker, "other")
            out.height, out.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            out.components = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            if not to_scan:
                return False
        elif marker == 0xDB:
            k = 0
            while k < len(body):
                wide, key = body[k] >> 4, body[k] & 15
                values = np.frombuffer(body[k + 1 : k + 1 + 64 * (1 + (wide > 0))], ">u2" if wide else "u1").astype("i4")
                table = np.zeros(64, "i4")
                table[ZIGZAG[: len(values)]] = values
                out.quant[key] = table
                k += 1 + 64 * (1 + (wide > 0))
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                n = sum(body[k + 1 : k + 17])
                out.huffman[body[k] >> 4, body[k] & 15] = lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + n])
                k += 17 + n
        elif marker == 0xDD:
            out.restart = int.from_bytes(body[:2], "big")
        elif marker == 0xEE and body[:5] == b"Adobe":
            out.adobe = body[11]
        elif marker == 0xDA:
            n, out.scan = body[0], []
            for i in range(n):
                for c in out.components:
                    if c.key == body[1 + 2 * i]:
                        c.dc, c.ac = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
                        out.scan.append(c)
            out.band = (body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15)
            out.scan_at = at
            return True
    return False


class Bits:
    """The entropy-coded bits up to the next marker, stuffed bytes taken out."""

    def __init__(self, data: bytes):
        self.value, self.have, self.data, self.at = 0, 0, data, 0

    def peek(self, n: int) -> int:
        while self.have < n:
            self.value = (self.value << 8 | (self.data[self.at] if self.at < len(self.data) else 0xFF)) & 0xFFFFFFFFFF
            self.at += 1
            self.have += 8
        return self.value >> (self.have - n) & ((1 << n) - 1)

    def symbol(self, table: list) -> int:
        length, symbol = table[self.peek(16)]
        if not length or self.at > len(self.data) + 8:
            raise JpegError("bad code")
        self.have -= length
        return symbol

    def take(self, n: int) -> int:
        if not n:
            return 0
        if n > 16:
            raise JpegError("bad size")
        v = self.peek(n)
        self.have -= n
        return v

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The scan's stretches between restart markers, and where it ends."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        marker = data[at + 1] if 0 <= at < len(data) - 1 else 0xD9
        if at >= 0 and marker == 0:
            at += 2
            continue
        end = at if at >= 0 else len(data)
        out.append(data[start:end].replace(b"\xff\0", b"\xff"))
        if at < 0 or not 0xD0 <= marker <= 0xD7:
            return out, end
        at = start = at + 2


def decode(data: bytes) -> np.ndarray:
    """(height, width, 1, 3 or 4) bytes: gray, RGB or CMYK."""
    head = read_header(data)
    if head.kind not in ("baseline", "extended", "progressive"):
        raise JpegError(f"{head.kind or 'no'} frame")
    if not (0 < head.width <= 65536 and 0 < head.height <= 65536) or len(head.components) not in (1, 3, 4):
        raise JpegError("dimensions")
    if any(not (0 < c.h <= 4 and 0 < c.v <= 4) for c in head.components):
        raise JpegError("sampling")
    if len(head.components) == 1:
        head.components[0].h = head.components[0].v = 1
    hm, vm = max(c.h for c in head.components), max(c.v for c in head.components)
    wide, high = -(-head.width // (8 * hm)), -(-head.height // (8 * vm))
    for c in head.components:
        c.blocks = np.zeros((high * c.v, wide * c.h, 64), "i4")
    more, scans = True, 0
    while more and scans < 1000:
        parts, end = segments(data, head.scan_at)
        try:
            run_scan(head, parts, wide, high, hm, vm)
        except KeyError:
            raise JpegError("missing table") from None
        scans += 1
        more = read_segments(data, end, head)
    return assembled(head, hm, vm)


def run_scan(head: Header, parts: list[bytes], wide: int, high: int, hm: int, vm: int) -> None:
    """All blocks of a scan: whole MCUs of several components, or the blocks that one has."""
    alone = head.scan[0] if len(head.scan) == 1 else None
    if not head.scan:
        raise JpegError("empty scan")
    if alone:
        columns, rows = -(-(-(-head.width * alone.h // hm)) // 8), -(-(-(-head.height * alone.v // vm)) // 8)
        units = [(alone, y, x) for y in range(rows) for x in range(columns)]
        each, total = 1, rows * columns
    else:
        units = [(c, y * c.v + by, x * c.h + bx) for y in range(high) for x in range(wide) for c in head.scan for by in range(c.v) for bx in range(c.h)]
        each, total = sum(c.v * c.h for c in head.scan), wide * high
    decode_block = baseline_block if head.kind != "progressive" else progressive_block
    step, at = (head.restart or total) * each, 0
    for part in parts:
        state = Scan(Bits(part), head, {id(c): 0 for c in head.scan})
        for c, y, x in units[at : at + step]:
            decode_block(state, c, c.blocks[y, x])
        at += step
        if at >= len(units):
            return


@dataclass
class Scan:
    bits: Bits
    head: Header
    last: dict[int, int]
    ended: int = 0  # blocks left of a run of ended ones


def baseline_block(s: Scan, c: Component, block: np.ndarray) -> None:
    bits, ac = s.bits, s.head.huffman[1, c.ac]
    s.last[id(c)] += bits.signed(bits.symbol(s.head.huffman[0, c.dc]))
    block[0] = s.last[id(c)]
    i = 1
    while i < 64:
        v = bits.symbol(ac)
        i += v >> 4
        if v & 15:
            if i > 63:
                raise JpegError("run beyond the block")
            block[ZIGZAG[i]] = bits.signed(v & 15)
        elif v != 0xF0:
            return
        i += 1


def progressive_block(s: Scan, c: Component, block: np.ndarray) -> None:
    first, last, before, low = s.head.band
    bits = s.bits
    if first == 0:
        if before:
            block[0] |= bits.take(1) << low
        else:
            s.last[id(c)] += bits.signed(bits.symbol(s.head.huffman[0, c.dc]))
            block[0] = s.last[id(c)] << low
        return
    if last > 63 or last < first:
        raise JpegError("band")
    (refine if before else first_pass)(s, s.head.huffman[1, c.ac], block, first, last, low)


def first_pass(s: Scan, table: list, block: np.ndarray, k: int, last: int, low: int) -> None:
    if s.ended:
        s.ended -= 1
        return
    bits = s.bits
    while k <= last:
        v = bits.symbol(table)
        run, size = v >> 4, v & 15
        if size:
            k += run
            if k > 63:
                raise JpegError("run beyond the block")
            block[ZIGZAG[k]] = bits.signed(size) * (1 << low)
        elif run < 15:
            s.ended = (1 << run) - 1 + bits.take(run)
            return
        else:
            k += 15
        k += 1


def refine(s: Scan, table: list, block: np.ndarray, k: int, last: int, low: int) -> None:
    """One more bit of the coefficients that are known, and new ones of one bit."""
    bits, one = s.bits, 1 << low

    def more(at: int) -> None:
        if bits.take(1) and not abs(int(block[at])) & one:
            block[at] += one if block[at] > 0 else -one

    while k <= last and not s.ended:
        v = bits.symbol(table)
        run, new = v >> 4, 0
        if v & 15:
            new = one if bits.take(1) else -one
        elif run < 15:
            s.ended = (1 << run) + bits.take(run)
            break
        while k <= last:
            at = ZIGZAG[k]
            k += 1
            if block[at]:
                more(at)
            elif run == 0:
                block[at] = new
                break
            else:
                run -= 1
    if s.ended:
        for at in ZIGZAG[k : last + 1]:
            if block[at]:
                more(at)
        s.ended -= 1


def assembled(head: Header, hm: int, vm: int) -> np.ndarray:
    """Blocks to pixels."""
    planes = []
    for c in head.components:
        if c.table not in head.quant:
            raise JpegError("missing quantisation")
        f = (c.blocks * head.quant[c.table]).reshape(*c.blocks.shape[:2], 8, 8).astype("f8")
        p = np.clip(np.floor(COSINES @ f @ COSINES.T + 128.5), 0, 255).astype("i4")
        p = p.transpose(0, 2, 1, 3).reshape(c.blocks.shape[0] * 8, -1)
        planes.append(p.repeat(vm // c.v, axis=0).repeat(hm // c.h, axis=1)[: head.height, : head.width])
    out = np.stack(planes, axis=2)
    if len(planes) >= 3 and head.adobe != 0:
        yy, cb, cr = out[..., 0], out[..., 1] - 128, out[..., 2] - 128
        out[..., :3] = np.clip(np.floor(np.stack([yy + 1.402 * cr, yy - 0.344136 * cb - 0.714136 * cr, yy + 1.772 * cb], axis=2) + 0.5), 0, 255)
    if len(planes) == 4 and head.adobe is not None:
        out = 255 - out
    return out.astype(np.uint8)
