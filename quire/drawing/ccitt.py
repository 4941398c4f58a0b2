"""Fax images: ITU-T T.4 one- and two-dimensional and T.6 coding."""

from __future__ import annotations

import numpy as np

# Fixed values of T.4: codes of run lengths 0 to 63, then of 64, 128, ... 1728.
WHITE = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101 101010 101011 0100111 0001100 0001000 0010111
0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010 00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000
00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010 00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001
01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011 011010100 011010101 011010110
011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000 0000010111 0000011000 0000001000 00001100111
00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011
000001010100 000001010101 000001010110 000001010111 000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111
000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100
0000001001101 0000001110010 0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101
0000001011010 0000001011011 0000001100100 0000001100101""".split()
#: Of 1792, 1856, ... 2560, in either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Two-dimensional modes: vertical offsets, pass and horizontal.
MODES = {"1": 0, "011": 1, "010": -1, "000011": 2, "000010": -2, "0000011": 3, "0000010": -3, "0001": "pass", "001": "horizontal"}
EOL = "000000000001"


def run_codes(codes: list[str]) -> dict[str, int]:
    lengths = [*range(64), *range(64, 1729, 64)]
    return dict(zip(codes, lengths)) | dict(zip(LONG, range(1792, 2561, 64)))


RUNS = (run_codes(WHITE), run_codes(BLACK))


class Damaged(Exception):
    pass


class Reader:
    def __init__(self, data: bytes):
        self.bits, self.at = "".join(f"{b:08b}" for b in data), 0

    def code(self, table: dict, longest: int):
        for n in range(1, longest + 1):
            found = table.get(self.bits[self.at : self.at + n])
            if found is not None and self.at + n <= len(self.bits):
                self.at += n
                return found
        raise Damaged

    def run(self, color: int) -> int:
        total = 0
        while True:
            n = self.code(RUNS[color], 13)
            total += n
            if n < 64:
                return total

    def skip_eol(self) -> bool:
        """Over fill bits and an end-of-line code, if one comes next."""
        end = self.bits.find("1", self.at)
        if end - self.at >= 11:
            self.at = end + 1
            return True
        return False

    def align(self) -> None:
        self.at = -(-self.at // 8) * 8


def one_dimensional(r: Reader, columns: int) -> list[int]:
    """Positions at which the colour changes, white first."""
    out, at, color = [], 0, 0
    while at < columns:
        at += r.run(color)
        out.append(min(at, columns))
        color ^= 1
    return out


def two_dimensional(r: Reader, above: list[int], columns: int) -> list[int]:
    out, a0, color = [], -1, 0
    while a0 < columns:
        # The first change of the line above right of a0, to the opposite of the current colour.
        k = 0
        while k < len(above) and (above[k] <= a0 or k % 2 != color):
            k += 1
        b1 = above[k] if k < len(above) else columns
        mode = r.code(MODES, 7)
        if mode == "pass":
            a0 = above[k + 1] if k + 1 < len(above) else columns
        elif mode == "horizontal":
            start = max(a0, 0)
            first = min(start + r.run(color), columns)
            a0 = min(first + r.run(color ^ 1), columns)
            out += [first, a0]
        else:
            a0 = min(max(b1 + mode, max(a0, 0)), columns)
            out.append(a0)
            color ^= 1
    return out


def decode(data: bytes, columns: int = 1728, rows: int = 0, k: int = 0, black_is_1: bool = False, byte_align: bool = False) -> np.ndarray:
    """(rows, columns) of samples 0 and 1. ``k`` below zero is T.6, zero one-dimensional,
    above it mixed. A damaged line ends the image; missing rows are white."""
    r, lines, above = Reader(data), [], []
    while not rows or len(lines) < rows:
        try:
            if byte_align:
                r.align()
            if k < 0:
                if r.bits.startswith(EOL, r.at):
                    break
                above = two_dimensional(r, above, columns)
            else:
                ends = 0
                while r.skip_eol():
                    ends += 1
                    if k > 0:
                        tag = r.bits[r.at : r.at + 1]
                        r.at += 1
                if ends > 1 or r.at >= len(r.bits):
                    break
                above = one_dimensional(r, columns) if k == 0 or not ends or tag == "1" else two_dimensional(r, above, columns)
        except Damaged:
            break
        lines.append(above)
    out = np.zeros((rows or len(lines), columns), np.uint8)
    for y, changes in enumerate(lines):
        for a, b in zip(changes[::2], [*changes[1::2], columns]):
            out[y, a:b] = 1
    return out if black_is_1 else 1 - out
