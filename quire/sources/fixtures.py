"""Small PDF files from content streams, for tests and queries without files."""

from __future__ import annotations


def build_pdf(contents: list[bytes], width: int = 200, height: int = 100, extra: list[bytes] = (), page_extra: bytes = b"", catalog_extra: bytes = b"") -> bytes:
    """One page per content stream. ``extra`` objects are numbered from 3 + 2 x pages on."""
    n = len(contents)
    kids = b" ".join(b"%d 0 R" % (3 + 2 * i) for i in range(n))
    objects = [b"<< /Type /Catalog /Pages 2 0 R " + catalog_extra + b">>", b"<< /Type /Pages /Kids [" + kids + b"] /Count %d /MediaBox [0 0 %d %d] >>" % (n, width, height)]
    for i, content in enumerate(contents):
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R " % (4 + 2 * i) + page_extra + b">>")
        objects.append(b"<< /Length %d >>\nstream\n" % len(content) + content + b"\nendstream")
    objects += extra
    out, places = bytearray(b"%PDF-1.4\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % i + body + b"\nendobj\n"
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1)
    for at in places:
        out += b"%010d 00000 n \n" % at
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    return bytes(out)


class ArithmeticWriter:
    """Stands in for the arithmetic decoder of JBIG2: what is put in is coded as it is asked for."""

    def __init__(self):
        self.wanted: list[int] = []
        self.a, self.c, self.left, self.out = 0x8000, 0, 12, bytearray([0])

    def put(self, bits: list[int]) -> None:
        self.wanted = list(bits)[::-1]

    def integer(self, value: int | None, ranges: list[tuple[int, int]]) -> None:
        size = abs(value or 0)
        k = max(i for i, (_, low) in enumerate(ranges) if size >= low)
        bits, low = ranges[k]
        sign = int(value is None or value < 0)
        self.put([sign, *[1] * k, *[0] * (k < 5), *[(size - low) >> i & 1 for i in range(bits - 1, -1, -1)]])

    def bit(self, contexts: list[int], k: int) -> int:
        from quire.drawing.jbig2 import STATES

        d, s = self.wanted.pop(), contexts[k]
        q, after_more, after_less, switch = STATES[s >> 1]
        likely = s & 1
        self.a -= q
        if d == likely:
            if self.a & 0x8000:
                self.c += q
                return d
            if self.a < q:
                self.a = q
            else:
                self.c += q
            contexts[k] = after_more << 1 | likely
        else:
            if self.a < q:
                self.c += q
            else:
                self.a = q
            contexts[k] = after_less << 1 | (1 - likely if switch else likely)
        while not self.a & 0x8000:
            self.a <<= 1
            self.c <<= 1
            self.left -= 1
            if not self.left:
                self.byte()
        return d

    def byte(self) -> None:
        if self.out[-1] != 0xFF and self.c >= 1 << 27:
            self.out[-1] += 1
            self.c &= (1 << 27) - 1
        if self.out[-1] == 0xFF:
            self.out.append(self.c >> 20)
            self.c &= (1 << 20) - 1
            self.left = 7
        else:
            self.out.append(self.c >> 19)
            self.c &= (1 << 19) - 1
            self.left = 8

    def finish(self) -> bytes:
        top = self.c + self.a
        self.c |= 0xFFFF
        if self.c >= top:
            self.c -= 0x8000
        for _ in range(2):
            self.c <<= self.left
            self.byte()
        return bytes(self.out[1:]) + b"\xff\xac"


def jbig2_segment(number: int, kind: int, body: bytes, refers: bytes = b"") -> bytes:
    return number.to_bytes(4, "big") + bytes([kind, len(refers) << 5]) + refers + b"\1" + len(body).to_bytes(4, "big") + body


def jbig2_region(rows: list[list[int]], template: int = 0, places: list[tuple[int, int]] | None = None, like_above: bool = False, number: int = 0) -> bytes:
    """A generic region of a bitmap, at the page's corner."""
    from quire.drawing.jbig2 import TEMPLATES, generic

    writer, places = ArithmeticWriter(), places or [(dx, dy) for _, dx, dy in TEMPLATES[template][5]]
    wanted, same = [], 0
    for y, row in enumerate(rows):
        if like_above:
            now = int(row == (rows[y - 1] if y else [0] * len(row)))
            wanted.append(now ^ same)
            same = now
        wanted += [] if like_above and same else row
    writer.put(wanted)
    generic(writer, [0] * (1 << 16), len(rows[0]), len(rows), template, places, like_above)
    head = len(rows[0]).to_bytes(4, "big") + len(rows).to_bytes(4, "big") + bytes(9) + bytes([template << 1 | like_above << 3])
    return jbig2_segment(number, 38, head + b"".join(bytes([x & 255, y & 255]) for x, y in places) + writer.finish())
