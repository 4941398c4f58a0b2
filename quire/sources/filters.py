"""Stream filters: bytes in, bytes out. They work on damaged input as far as it goes."""

from __future__ import annotations

import re
import zlib

#: Bytes that a stream may grow to, and filters in a chain.
MAX_OUTPUT, MAX_CHAIN = 1 << 30, 32
SHORT = {"A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode"}


class FilterError(ValueError):
    pass


def flate(data: bytes) -> bytes:
    for wbits in (15, -15):
        d, out = zlib.decompressobj(wbits), bytearray()
        try:
            out += d.decompress(data, MAX_OUTPUT)
            return bytes(out)
        except zlib.error:
            # Bytes before the damage count.
            d, out = zlib.decompressobj(wbits), bytearray()
            try:
                for i in range(0, len(data), 64):
                    out += d.decompress(data[i : i + 64])
            except zlib.error:
                if out:
                    return bytes(out)
    raise FilterError("not a deflate stream")


def lzw(data: bytes, early: int = 1) -> bytes:
    out, width, bits, held = bytearray(), 9, 0, 0
    words: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code == 257:
            break
        if code < len(words):
            word = words[code]
        elif code == len(words) and last:
            word = last + last[:1]
        else:
            break
        out += word
        if len(out) > MAX_OUTPUT:
            raise FilterError("too large")
        if last and len(words) < 4096:
            words.append(last + word[:1])
        last = word
        size = len(words) + early
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    text = re.sub(rb"\s", b"", data.split(b"~>")[0]).removeprefix(b"<~")
    out, group = bytearray(), []
    for c in text:
        if c == 0x7A and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += four(group)
                group = []
        else:
            raise FilterError(f"byte {c} in ASCII85")
    if len(group) > 1:
        n = len(group) - 1
        out += four(group + [84] * (5 - len(group)))[:n]
    return bytes(out)


def four(group: list[int]) -> bytes:
    value = 0
    for g in group:
        value = value * 85 + g
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
    return bytes(out)


def predicted(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes:
    if predictor < 2:
        return data
    import numpy as np

    step, stride = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor == 2:
        if bits != 8:
            raise FilterError(f"TIFF predictor of {bits} bits")
        rows = np.frombuffer(data[: len(data) // stride * stride], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    data += bytes(-len(data) % (stride + 1))
    rows = np.frombuffer(data, np.uint8).reshape(-1, stride + 1)
    out, above = np.empty((len(rows), stride), np.uint8), np.zeros(stride, np.uint8)
    kinds, changed = rows[:, 0].tolist(), rows[:, 1:].any(axis=1)
    k = 0
    while k < len(kinds):
        kind, raw = kinds[k], rows[k, 1:]
        if kind in (2, 4) and not changed[k]:  # like the row above, and so may be those after it
            last = k + 1
            while last < len(kinds) and kinds[last] in (2, 4) and not changed[last]:
                last += 1
            out[k:last] = above
            k = last
            continue
        if kind == 2:
            out[k] = raw + above
        elif kind == 1:
            pad = -stride % step
            out[k] = np.cumsum(np.append(raw, np.zeros(pad, np.uint8)).reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:stride]
        elif kind == 4:
            for lane in range(step):
                out[k, lane::step] = paeth_row(raw[lane::step], above[lane::step])
        elif kind == 3:
            line, up = bytearray(raw.tobytes()), above.tolist()
            for i in range(stride):
                line[i] = (line[i] + ((line[i - step] if i >= step else 0) + up[i]) // 2) & 255
            out[k] = np.frombuffer(line, np.uint8)
        else:
            out[k] = raw
        above = out[k]
        k += 1
    return out.tobytes()


def paeth_row(raw, above):
    """A row of one channel. Where the differences are zero, the guess stays with what is above as long as the
    pixel to the left is like the one above it, and with what is to the left as long as the row above is level:
    such runs are taken at once."""
    import numpy as np

    n = len(raw)
    line, given, up = bytearray(above.tobytes()), raw.tobytes(), above.tobytes()
    marks = [*np.flatnonzero(raw).tolist(), n]
    steps = [*(np.flatnonzero(above[1:] != above[:-1]) + 1).tolist(), n]
    i = m = s = a = c = 0
    while i < n:
        while marks[m] < i:
            m += 1
        if a == c and i < marks[m]:  # the row above is in place already
            i = marks[m]
            if i:
                a, c = line[i - 1], up[i - 1]
            continue
        if i and i < marks[m]:
            while steps[s] < i:
                s += 1
            end = min(steps[s], marks[m])
            if end > i:  # level above
                line[i:end] = bytes([a]) * (end - i)
                c = up[end - 1]
                i = end
                continue
        b = up[i]
        line[i] = a = (given[i] + paeth(a, b, c)) & 255
        c = b
        i += 1
    return np.frombuffer(line, np.uint8)


def paeth(a: int, b: int, c: int) -> int:
    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


DECODERS = {"FlateDecode": flate, "LZWDecode": lzw, "ASCII85Decode": ascii85, "ASCIIHexDecode": ascii_hex, "RunLengthDecode": run_length}


def decode_chain(data: bytes, names: list[str], parms: list[dict]) -> tuple[bytes, str | None]:
    """Through all filters; an image codec at the end is left alone and named."""
    if len(names) > MAX_CHAIN:
        raise FilterError("too many filters")
    for name, p in zip(names, parms + [{}] * len(names)):
        name = SHORT.get(name, name)
        if name not in DECODERS:
            return data, name
        data = lzw(data, int(p.get("EarlyChange", 1))) if name == "LZWDecode" else DECODERS[name](data)
        if name in ("FlateDecode", "LZWDecode"):
            data = predicted(data, int(p.get("Predictor", 1)), int(p.get("Colors", 1)), int(p.get("BitsPerComponent", 8)), int(p.get("Columns", 1)))
    return data, None
