"""PDF files as tables: a reader of objects, pages and content operators in plain Python.

Objects map to Python: numbers, bool, None, :class:`Name`, bytes, lists, dicts, :class:`Ref`
and :class:`Stream`. The Spark side is in :mod:`quire.sources.pdf_tables`.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

from quire.sources.filters import FilterError, decode_chain

WHITE, DELIMITERS = b"\0\t\n\f\r ", b"()<>[]{}/%"
REGULAR = re.compile(rb"[^\0\t\n\f\r ()<>\[\]{}/%]+")
BLANK = re.compile(rb"(?:[\0\t\n\f\r ]|%[^\r\n]*)*")
OBJECT = re.compile(rb"(\d+)[\0\t\n\f\r ]+(\d+)[\0\t\n\f\r ]+obj\b")
START = re.compile(rb"startxref[\0\t\n\f\r ]+(\d+)")
END_STREAM = re.compile(rb"[\0\t\n\f\r ]*endstream")
OCTAL = re.compile(rb"[0-7]{1,3}")
ESCAPED = re.compile(rb"#([0-9A-Fa-f]{2})")
MAX_DEPTH, MAX_PAGE_DEPTH, MAX_CHAIN = 256, 64, 32
ESCAPES = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}


class PdfError(ValueError):
    """``kind`` names the error for the error column."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.message = kind, message


class Name(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int
    gen: int


@dataclass
class Stream:
    info: dict
    raw: bytes


@dataclass(slots=True)
class Op:
    keyword: str
    operands: list = field(default_factory=list)


#: A line of a cross-reference table.
ENTRY = re.compile(rb"[\0\t\n\f\r ]*(\d{10}) (\d{5}) ([nf])(?=[\0\t\n\f\r ])").match

_SPACE, _REGULAR = rb"[\0\t\n\f\r ]", rb"[^\0\t\n\f\r \(\)<>\[\]{}/%]"
_BLANK = rb"[\0\t\n\f\r ]*+(?:%[^\r\n]*+[\0\t\n\f\r ]*+)*+"
_REFERENCE = rb"(\d++)" + _SPACE + rb"++(\d++)" + _SPACE + rb"++R(?!" + _REGULAR + rb")"
_NUMBERS = rb"([+-]?\d++)(?!" + _REGULAR + rb")|([+-]?(?:\d++\.\d*+|\.\d++))(?!" + _REGULAR + rb")"
_NEVER = rb"(?!)()()"


def _token(reference: bytes):
    """1 name, 2 and 3 reference, 4 whole, 5 real, 6 dictionary, 7 array, 8 plain string, 9 string,
    10 hexadecimal string, 11 one without end, 12 word, 13 other."""
    return re.compile(_BLANK + rb"(?:/(" + _REGULAR + rb"*+)|" + reference + rb"|" + _NUMBERS + rb"|(<<)|(\[)|\(([^()\\]*+)\)|(\()|<([^>]*+)>|(<)|(" + _REGULAR + rb"++)|(>>|.))", re.S).match


def unmarked(pattern: bytes) -> bytes:
    """The same without capturing groups."""
    return re.sub(rb"(?<!\\)\((?!\?)", b"(?:", pattern)


def _pairs(reference: bytes):
    """Keys with plain values up to what is unlike them, and the end of the dictionary if that comes next;
    each as key, name with its slash, reference, whole or real. Names have no escapes."""
    name = rb"/[^\0\t\n\f\r \(\)<>\[\]{}/%#]*+(?!#)"
    pair = _BLANK + rb"(" + name + rb")" + _BLANK + rb"(?:(" + name + rb")|" + reference + rb"|" + _NUMBERS + rb")"
    return re.compile(rb"((?:" + unmarked(pair) + rb")*+)(?:" + _BLANK + rb"(>>))?").match, re.compile(pair).findall


TOKEN, PLAIN_TOKEN = _token(_REFERENCE), _token(_NEVER)
PAIRS, PLAIN_PAIRS = _pairs(_REFERENCE), _pairs(_NEVER)
#: The first number of a subsection of a cross-reference table, how many there are, and its lines.
SUBSECTION = re.compile(_BLANK + rb"(\d++)" + _SPACE + rb"++(\d++)(?!" + _REGULAR + rb")((?:" + _SPACE + rb"*+\d{10} \d{5} [nf](?=" + _SPACE + rb"))*+)").match
TRAILER = re.compile(_BLANK + rb"trailer(?!" + _REGULAR + rb")" + _BLANK + rb"<<").match
LINES = re.compile(rb"(\d{10}) (\d{5}) ([nf])").findall
#: An indirect object, and whether it is a dictionary or a stream.
STREAM = re.compile(_BLANK + rb"stream(?:\r\n|[\r\n])?").match
INDIRECT = re.compile(rb"(\d++)" + _SPACE + rb"++(\d++)" + _SPACE + rb"++obj\b(?:" + _BLANK + rb"(<<))?").match
#: Numbers up to the end of their array.
NUMBER_ARRAY = re.compile(rb"((?:[\t\n\f\r ]*+[+-]?(?:\d++\.?\d*+|\.\d++)(?=[\t\n\f\r \]]))++)[\t\n\f\r ]*+\]").match
#: Operators after plain numbers, many at a time, and each.
_OPERATION = rb"[\t\n\f\r ]*+((?:[+-]?(?:\d++\.?\d*+|\.\d++)[\t\n\f\r ]++)*+)(?!(?:BI|true|false|null)(?!" + _REGULAR + rb"))([A-Za-z'\"]" + _REGULAR + rb"*+)"
OPERATIONS = re.compile(rb"(?:" + unmarked(_OPERATION) + rb"){1,1000}+").match
EACH_OPERATION = re.compile(_OPERATION).findall
CONSTANTS = {b"true": True, b"false": False, b"null": None}
#: Dictionaries that objects of few bytes have turned out to be, by these bytes up to their end, and how
#: many are kept. Files of one maker repeat them: catalogs, page trees, fonts.
KNOWN: dict[bytes, dict] = {}
TRAILERS: dict[bytes, dict] = {}
MOST_KNOWN, KNOWN_BYTES = 2048, 2048
#: Names that were read before, up to a bound.
NAMES: dict[bytes, Name] = {}
MOST_NAMES = 1 << 14


def name_of(raw: bytes) -> Name:
    found = NAMES.get(raw)
    if found is None:
        found = Name((ESCAPED.sub(lambda h: bytes([int(h[1], 16)]), raw) if b"#" in raw else raw).decode("latin-1"))
        if len(NAMES) < MOST_NAMES and len(raw) < 64:
            NAMES[raw] = found
    return found


def numbers_of(text: bytes) -> list:
    return [float(x) if b"." in x else int(x) for x in text.split()]


class Lexer:
    """Reads objects of ``data`` from ``pos`` on. ``keyword`` results are :class:`Op`."""

    def __init__(self, data: bytes, pos: int = 0, references: bool = True):
        self.data, self.pos, self.references = data, pos, references

    def skip(self) -> int:
        self.pos = BLANK.match(self.data, self.pos).end()
        return self.pos

    def read(self, depth: int = 0):
        """The next object; an Op for a bare word; EOFError at the end."""
        if depth > MAX_DEPTH:
            raise PdfError("BadObject", "nested too deeply")
        m = (TOKEN if self.references else PLAIN_TOKEN)(self.data, self.pos)
        if m is None:
            self.pos = len(self.data)
            raise EOFError
        self.pos, kind = m.end(), m.lastindex
        if kind == 1:
            return name_of(m[1])
        if kind == 3:
            return Ref(int(m[2]), int(m[3]))
        if kind == 4:
            return int(m[4])
        if kind == 5:
            return float(m[5])
        if kind == 6:
            return self.dictionary(depth)
        if kind == 7:
            return self.array(depth)
        if kind == 8:
            return m[8]
        if kind == 9:
            self.pos -= 1
            return self.literal()
        if kind == 10 or kind == 11:
            raw = m[10]
            if kind == 11:
                raw, self.pos = self.data[m.end() :], len(self.data) + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", raw)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        word = m[kind]
        return CONSTANTS[word] if word in CONSTANTS else Op(word.decode("latin-1"))

    def literal(self) -> bytes:
        data, i, depth, out = self.data, self.pos + 1, 1, bytearray()
        while i < len(data):
            c = data[i]
            i += 1
            if c == 0x5C and i < len(data):
                c = data[i]
                i += 1
                if 0x30 <= c <= 0x37:
                    m = OCTAL.match(data, i - 1)
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                elif c == 13:
                    i += data[i : i + 1] == b"\n"
                elif c != 10:
                    out.append(ESCAPES.get(c, c))
                continue
            depth += (c == 0x28) - (c == 0x29)
            if not depth:
                break
            out.append(c)
        self.pos = i
        return bytes(out)

    def array(self, depth: int) -> list:
        if m := NUMBER_ARRAY(self.data, self.pos):
            if depth + 1 > MAX_DEPTH:
                raise PdfError("BadObject", "nested too deeply")
            self.pos = m.end()
            return numbers_of(m[1])
        out = []
        while True:
            try:
                item = self.read(depth + 1)
            except EOFError:
                return out
            if isinstance(item, Op):
                if item.keyword == "]":
                    return out
                continue
            out.append(item)

    def dictionary(self, depth: int) -> dict:
        out: dict = {}
        run, pairs = PAIRS if self.references else PLAIN_PAIRS
        while True:
            if depth < MAX_DEPTH:
                m = run(self.data, self.pos)
                self.pos = m.end()
                if m.end(1) > m.start(1):  # as most are
                    for key, name, num, gen, whole, real in pairs(m[1]):
                        out[key[1:].decode("latin-1")] = name_of(name[1:]) if name else Ref(int(num), int(gen)) if num else int(whole) if whole else float(real)
                if m.lastindex > 1 and m[m.lastindex] == b">>":
                    return out
            try:
                key = self.read(depth + 1)
                if isinstance(key, Op):
                    if key.keyword == ">>":
                        return out
                    continue
                if isinstance(key, Name):
                    value = self.read(depth + 1)
                    if isinstance(value, Op):
                        if value.keyword == ">>":
                            return out
                        continue
                    out[str(key)] = value
            except EOFError:
                return out


def as_int(x, default: int = 0) -> int:
    return int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else default


class Document:
    """Cross-references, objects and pages of one file; objects are parsed when asked for."""

    def __init__(self, data: bytes):
        if not data:
            raise PdfError("EmptyFile")
        if data.find(b"%PDF-", 0, 1024) < 0:
            raise PdfError("NotAPdf")
        self.data, self.cache, self.containers, self.found = data, {}, {}, None
        self.fonts: dict = {}  # by the identity of their dictionaries, which the cache holds
        #: number -> (kind, offset or container, generation or index, section)
        self.xref: dict[int, tuple[str, int, int, int]] = {}
        self.trailer: dict = {}
        try:
            self.follow(self.start())
            if "Root" not in self.trailer:
                raise PdfError("BadXref", "no root")
            if not isinstance(self.get(self.trailer["Root"]), dict):
                raise PdfError("BadXref", "root is no dictionary")
        except (PdfError, ValueError, EOFError, IndexError):
            self.rebuild()

    def start(self) -> int:
        at = self.data.rfind(b"startxref")
        m = START.match(self.data, at) if at >= 0 else None
        if not m:
            raise PdfError("BadXref", "no startxref")
        return int(m[1])

    def follow(self, offset: int) -> None:
        """Sections from the newest on; the first entry of an object stays."""
        seen: set[int] = set()
        queue, section = [offset], 0
        while queue:
            at = queue.pop(0)
            if at in seen or not 0 <= at < len(self.data):
                if at in seen:
                    continue
                raise PdfError("BadXref", f"offset {at}")
            seen.add(at)
            at = at if self.data.startswith(b"xref", at) else BLANK.match(self.data, at).end()
            info = self.table(at, section) if self.data.startswith(b"xref", at) else self.stream_section(at, section)
            self.trailer = {**info, **self.trailer}
            section += 1
            queue += [int(info[k]) for k in ("XRefStm", "Prev") if isinstance(info.get(k), (int, float))]

    def table(self, at: int, section: int) -> dict:
        lexer = Lexer(self.data, at + 4, references=False)
        while True:
            m = SUBSECTION(self.data, lexer.pos)
            if m and len(lines := LINES(m[3])) == int(m[2]):  # as it should be
                lexer.pos = m.end()
                for num, (offset, gen, kind) in enumerate(lines, int(m[1])):
                    if num in self.xref:
                        continue
                    if kind == b"f":
                        self.xref[num] = ("free", 0, int(gen), section)
                    elif offset := int(offset):
                        self.xref[num] = ("direct", offset, int(gen), section)
                continue
            if m := TRAILER(self.data, lexer.pos):
                begin = lexer.pos = m.end()
                end = self.data.find(b"startxref", begin, begin + KNOWN_BYTES)
                known = TRAILERS.get(self.data[begin:end]) if end >= 0 else None
                if known is None:
                    lexer.references = True
                    known = lexer.dictionary(0)
                    if end >= 0 and lexer.skip() == end:
                        if len(TRAILERS) >= MOST_KNOWN:
                            TRAILERS.clear()
                        TRAILERS[self.data[begin:end]] = known
                return dict(known)
            first = lexer.read()
            if isinstance(first, Op):
                break
            count = lexer.read()
            if not isinstance(first, int) or isinstance(first, bool):
                raise PdfError("BadXref", "no number of an object")
            k = 0
            while k < as_int(count) and (m := ENTRY(self.data, lexer.pos)):  # as they should be
                if m[3] == b"n" and int(m[1]):
                    self.xref.setdefault(first + k, ("direct", int(m[1]), int(m[2]), section))
                elif m[3] == b"f":
                    self.xref.setdefault(first + k, ("free", 0, int(m[2]), section))
                lexer.pos = m.end()
                k += 1
            for k in range(k, as_int(count)):
                offset, gen, kind = lexer.read(), lexer.read(), lexer.read()
                if isinstance(kind, Op) and kind.keyword == "n" and as_int(offset):
                    self.xref.setdefault(first + k, ("direct", as_int(offset), as_int(gen), section))
                elif isinstance(kind, Op) and kind.keyword == "f":
                    self.xref.setdefault(first + k, ("free", 0, as_int(gen), section))
        if first.keyword != "trailer":
            raise PdfError("BadXref", "no trailer")
        lexer.references = True
        info = lexer.read()
        if not isinstance(info, dict):
            raise PdfError("BadXref", "no trailer dictionary")
        return info

    def stream_section(self, at: int, section: int) -> dict:
        _, found = self.indirect(at)
        if not isinstance(found, Stream) or found.info.get("Type") != "XRef":
            raise PdfError("BadXref", "no section")
        rows, widths = self.decoded(found), [as_int(w) for w in found.info.get("W", [])]
        if len(widths) < 3:
            raise PdfError("BadXref", "widths")
        index = found.info.get("Index") or [0, found.info.get("Size", 0)]
        step, place = sum(widths), 0
        for first, count in zip(index[::2], index[1::2]):
            for k in range(as_int(count)):
                row = rows[place : place + step]
                if len(row) < step or not step:
                    break
                place += step
                kind = int.from_bytes(row[: widths[0]], "big") if widths[0] else 1
                a, b = int.from_bytes(row[widths[0] : widths[0] + widths[1]], "big"), int.from_bytes(row[widths[0] + widths[1] :], "big")
                if kind in (0, 1, 2):
                    self.xref.setdefault(first + k, (("free", "direct", "packed")[kind], a, b, section))
        return found.info

    def rebuild(self) -> None:
        """From the objects that can be found; later ones win."""
        self.xref, self.cache, self.trailer = {}, {}, {}
        for m in OBJECT.finditer(self.data):
            self.xref[int(m[1])] = ("direct", m.start(), int(m[2]), 0)
        for m in re.finditer(rb"trailer", self.data):
            try:
                info = Lexer(self.data, m.end()).read()
                if isinstance(info, dict):
                    self.trailer |= info
            except (EOFError, PdfError):
                pass
        packed = [n for n in self.xref if isinstance(s := self.get(Ref(n, 0)), Stream) and s.info.get("Type") == "ObjStm"]
        for n in packed:
            for index, num in enumerate(self.container(n)):
                self.xref.setdefault(num, ("packed", n, index, 0))
        if "Root" not in self.trailer:
            for n in self.xref:
                found = self.get(Ref(n, 0))
                info = found.info if isinstance(found, Stream) else found
                if isinstance(info, dict):
                    if info.get("Type") == "Catalog":
                        self.trailer["Root"] = Ref(n, 0)
                    elif info.get("Type") == "XRef":
                        self.trailer = {**{k: info[k] for k in ("Root", "Encrypt") if k in info}, **self.trailer}
        if "Root" not in self.trailer:
            raise PdfError("BadXref", "no catalog found")

    def indirect(self, at: int):
        m = INDIRECT(self.data, at) or INDIRECT(self.data, BLANK.match(self.data, at).end())
        if not m:
            raise PdfError("BadObject", f"none at {at}")
        own, begin, end = Ref(int(m[1]), int(m[2])), m.end(), -1
        if m[3]:
            end = self.data.find(b"endobj", begin, begin + KNOWN_BYTES)
            known = KNOWN.get(self.data[begin:end]) if end >= 0 else None
            if known is not None:
                return own, dict(known)
        lexer = Lexer(self.data, begin)
        found = lexer.dictionary(0) if m[3] else lexer.read()
        if end >= 0 and lexer.skip() == end:
            if len(KNOWN) >= MOST_KNOWN:
                KNOWN.clear()
            KNOWN[self.data[begin:end]] = dict(found)
        elif isinstance(found, dict) and (body := STREAM(self.data, lexer.pos)):
            begin = body.end()
            length = found.get("Length")
            length = self.get(length) if isinstance(length, Ref) else length
            stop = begin + as_int(length, -1)
            if stop < begin or not END_STREAM.match(self.data, stop):
                stop = self.data.find(b"endstream", begin)
                stop = len(self.data) if stop < 0 else stop
                stop -= 2 if self.data[stop - 2 : stop] == b"\r\n" else self.data[stop - 1 : stop] in (b"\n", b"\r")
            found = Stream(found, self.data[begin:stop])
        return own, found

    def container(self, num: int) -> dict[int, int]:
        """Numbers in an object stream and their offsets in its data."""
        if num not in self.containers:
            stream = self.get(Ref(num, 0))
            if not isinstance(stream, Stream):
                raise PdfError("BadObject", f"no object stream {num}")
            data, first = self.decoded(stream), as_int(stream.info.get("First"))
            head = [int(x) for x in data[:first].split()]
            self.containers[num] = data, {n: first + o for n, o in zip(head[::2], head[1::2])}
        return self.containers[num][1]

    def get(self, ref, hops: int = 0):
        """The object behind a reference (or the object itself); None if there is none."""
        if ref.__class__ is not Ref:
            return ref
        if hops > MAX_CHAIN:
            return None
        if ref.num not in self.cache:
            self.cache[ref.num] = None  # for cycles
            kind, a, b, _ = self.xref.get(ref.num, ("free", 0, 0, 0))
            try:
                if kind == "direct":
                    own, found = self.indirect(a)
                    self.cache[ref.num] = found if own.num == ref.num else None
                elif kind == "packed" and ref.num in self.container(a):
                    data, places = self.containers[a]
                    self.cache[ref.num] = Lexer(data, places[ref.num]).read()
            except (PdfError, FilterError, EOFError, ValueError):
                pass
        found = self.cache[ref.num]
        return self.get(found, hops + 1) if found.__class__ is Ref else found

    def decoded(self, stream: Stream) -> bytes:
        data, codec = self.decoded_as(stream)
        if codec:
            raise FilterError(codec)
        return data

    def decoded_as(self, stream: Stream) -> tuple[bytes, str | None]:
        """(data, name of an image codec left at the end)."""
        names, parms = self.get(stream.info.get("Filter")), self.get(stream.info.get("DecodeParms", stream.info.get("DP")))
        names = [names] if isinstance(names, Name) else [self.get(n) for n in names or []]
        parms = [parms] if isinstance(parms, dict) else [self.get(p) or {} for p in parms or []]
        plain = [{k: v for k, v in ((k, self.get(v)) for k, v in p.items()) if isinstance(v, (int, float))} for p in parms]
        return decode_chain(stream.raw, [str(n) for n in names], plain)

    @property
    def encrypted(self) -> bool:
        return "Encrypt" in self.trailer

    def pages(self) -> list[tuple[int, dict, dict]]:
        """(object number, page, attributes with what is inherited), in order."""
        if self.found is None:
            self.found = self.walked()
        return self.found

    def walked(self) -> list[tuple[int, dict, dict]]:
        out: list[tuple[int, dict, dict]] = []
        root = self.get(self.trailer["Root"])
        stack = [(root.get("Pages") if isinstance(root, dict) else None, {}, 0)]
        seen: set[int] = set()
        while stack:
            ref, above, depth = stack.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > MAX_PAGE_DEPTH or isinstance(ref, Ref) and ref.num in seen:
                continue
            if isinstance(ref, Ref):
                seen.add(ref.num)
            own = above | {k: node[k] for k in ("MediaBox", "CropBox", "Rotate", "Resources", "UserUnit") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list) and node.get("Type") != "Page":
                stack += [(k, own, depth + 1) for k in reversed(kids)]
            else:
                out.append((ref.num if isinstance(ref, Ref) else 0, node, own))
        return out

    def box(self, value) -> tuple[float, float, float, float] | None:
        value = self.get(value)
        if value.__class__ is list and len(value) == 4 and all(v.__class__ is int or v.__class__ is float for v in value):
            a, b, c, d = value
            return float(min(a, c)), float(min(b, d)), float(max(a, c)), float(max(b, d))
        items = [self.get(v) for v in value] if isinstance(value, list) else []
        if len(items) < 4 or not all(isinstance(v, (int, float)) for v in items[:4]):
            return None
        x0, y0, x1, y1 = map(float, items[:4])
        return min(x0, x1), min(y0, y1), max(x0, x1), max(y0, y1)

    def geometry(self, own: dict) -> dict:
        """Size in points as shown, rotation clockwise, unit and origin."""
        media = self.box(own.get("MediaBox")) or (0.0, 0.0, 612.0, 792.0)
        crop = self.box(own.get("CropBox")) or media
        both = max(media[0], crop[0]), max(media[1], crop[1]), min(media[2], crop[2]), min(media[3], crop[3])
        if both[0] >= both[2] or both[1] >= both[3]:
            both = media
        unit = self.get(own.get("UserUnit"))
        unit = float(unit) if isinstance(unit, (int, float)) and unit > 0 else 1.0
        turn = as_int(self.get(own.get("Rotate"))) % 360
        w, h = (both[2] - both[0]) * unit, (both[3] - both[1]) * unit
        return {"width_pts": h if turn in (90, 270) else w, "height_pts": w if turn in (90, 270) else h, "rotate_cw": turn, "user_unit": unit, "origin_x": both[0], "origin_y": both[1]}

    def content(self, page: dict) -> bytes:
        found = self.get(page.get("Contents"))
        parts = found if isinstance(found, list) else [found]
        out = []
        for p in parts:
            s = self.get(p)
            if isinstance(s, Stream):
                try:
                    out.append(self.decoded(s))
                except FilterError:
                    pass
        return b"\n".join(out)

    def javascript(self) -> list[str]:
        """Where scripts are; they are named, never run."""
        found, root = [], self.get(self.trailer["Root"])
        if isinstance(root, dict):
            action = self.get(root.get("OpenAction"))
            if isinstance(action, dict) and action.get("S") == "JavaScript":
                found.append("OpenAction")
            names = self.get(root.get("Names"))
            if isinstance(names, dict) and "JavaScript" in names:
                found.append("Names")
            found += ["Catalog.AA"] * ("AA" in root)
        for n, (_, page, _) in enumerate(self.pages()[:4096], 1):
            found += [f"Page {n}"] * ("AA" in page)
        return found


#: Keywords of content operators.
OPERATORS = frozenset(
    "b B b* B* BDC BI BMC BT BX c cm CS cs d d0 d1 Do DP EI EMC ET EX f F f* G g gs h i ID j J K k l m M MP n q Q re RG rg ri s S SC sc SCN scn sh T* Tc Td TD Tf Tj TJ TL Tm Tr Ts Tw Tz v w W W* y ' \"".split()
)


def content_ops(data: bytes, most: int = 50_000_000):
    """Operators with their operands, in order. An inline image is one BI operator with its
    dictionary and bytes. Unknown keywords come as they are."""
    lexer, operands, n = Lexer(data, references=False), [], 0
    while n < most:
        if m := OPERATIONS(data, lexer.pos):  # as most are
            lexer.pos = m.end()
            for numbers, word in EACH_OPERATION(m[0])[: most - n]:
                values = numbers_of(numbers)
                yield Op(word.decode("latin-1"), operands + values if operands else values)
                operands = []
                n += 1
            continue
        try:
            item = lexer.read()
        except (EOFError, PdfError):
            return
        if not isinstance(item, Op):
            operands.append(item)
            continue
        if item.keyword == "BI":
            item.operands = list(inline_image(lexer))
        elif item.keyword in "[]{}>>" and item.keyword not in OPERATORS:
            continue
        else:
            item.operands = operands
        operands = []
        n += 1
        yield item


INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}


def inline_image(lexer: Lexer):
    info: dict = {}
    try:
        while not isinstance(key := lexer.read(), Op):
            value = lexer.read()
            key = INLINE_KEYS.get(str(key), str(key))
            info[key] = Name(INLINE_SPACES.get(value, value)) if key == "ColorSpace" and isinstance(value, Name) else value
    except EOFError:
        return info, b""
    start = lexer.pos + 1
    end = re.compile(rb"[\0\t\n\f\r ]EI(?![^\0\t\n\f\r ])").search(lexer.data, start)
    lexer.pos = end.end() if end else len(lexer.data)
    return info, lexer.data[start : end.start() if end else len(lexer.data)]
