"""Character maps, widths and encodings of fonts."""

from __future__ import annotations

from collections.abc import Iterator

from quire.sources.pdf import Lexer, Name, Op

MOST_CODES = 65_536


def cmap(data: bytes) -> Iterator[tuple[int, int]]:
    """(code, CID or Unicode) of the character and range mappings of a CMap stream. Later
    ones win; ranges of 65,536 codes and more are left out."""
    lexer, held = Lexer(data, references=False), []
    number = lambda b: int.from_bytes(b, "big") if isinstance(b, bytes) else int(b)
    while True:
        try:
            item = lexer.read()
        except EOFError:
            return
        if not isinstance(item, Op):
            held.append(item)
            continue
        try:
            if item.keyword in ("endcidchar", "endbfchar"):
                for code, value in zip(held[::2], held[1::2]):
                    yield number(code), number(value)
            elif item.keyword in ("endcidrange", "endbfrange"):
                for low, high, value in zip(held[::3], held[1::3], held[2::3]):
                    a, b = number(low), number(high)
                    if b - a + 1 >= MOST_CODES:
                        continue
                    if isinstance(value, list):
                        yield from ((a + k, number(v)) for k, v in enumerate(value[: b - a + 1]))
                    else:
                        yield from ((a + k, number(value) + k) for k in range(b - a + 1))
        except (TypeError, ValueError):
            pass
        held = []


def cid_widths(w: list) -> list[tuple[int, int, int, list[int]]]:
    """(order, first, last, widths) of a W array: ``c [w ...]`` or ``first last w``. One width
    stands for a whole range. At most 65,536 slots."""
    out, i, slots = [], 0, 0
    whole = lambda x: int(x) if isinstance(x, int) and not isinstance(x, bool) else 0
    while i + 1 < len(w):
        first = w[i]
        if isinstance(w[i + 1], list):
            widths, last = [whole(x) for x in w[i + 1]], whole(first) + len(w[i + 1]) - 1
            i += 2
        elif i + 2 < len(w):
            widths, last = [whole(w[i + 2])], whole(w[i + 1])
            i += 3
        else:
            break
        n = last - whole(first) + 1
        if isinstance(first, int) and first >= 0 and 0 < n < MOST_CODES and slots + n <= MOST_CODES:
            slots += n
            out.append((len(out), first, last, widths))
    return out


def differences(base: dict[int, str], changes: list) -> dict[int, str]:
    """Glyph names by code: a base encoding with a Differences array laid over it."""
    out, code = dict(base), 0
    for item in changes:
        if isinstance(item, Name):
            if code < 256:
                out[code] = str(item)
            code += 1
        elif isinstance(item, int):
            code = max(item, 0)
    return out


def advance(widths: list[float], size: float, char_space: float, word_space: float, scale: float, spaces: list[bool]) -> float:
    """Of a shown string: widths in thousandths; word space counts on single-byte blanks."""
    return sum((w / 1000 * size + char_space + (word_space if s else 0.0)) * scale for w, s in zip(widths, spaces))
