"""Fonts of a page: codes to glyphs and widths, and their outlines."""

from __future__ import annotations

import os
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

from quire.drawing.outlines import STANDARD_NAMES, Face, FontError, Outline, open_face
from quire.sources.filters import FilterError
from quire.sources.fonts import cid_widths, cmap, differences
from quire.sources.pdf import Document, Name, Stream, as_int

MAX_PROGRAM, MAX_CID_MAP, MAX_CHAR_PROC = 64 << 20, 128 << 10, 4 << 20
#: Tried in order for fonts without a program of their own.
FALLBACKS = ["/usr/share/fonts/truetype/dejavu/DejaVuSans.ttf", "/usr/share/fonts/truetype/liberation/LiberationSans-Regular.ttf", "/usr/share/fonts/truetype/freefont/FreeSans.ttf"]
#: Names of marks in glyph names, by their names in Unicode.
MARKS = {"ACUTE": "acute", "GRAVE": "grave", "CIRCUMFLEX": "circumflex", "DIAERESIS": "dieresis", "TILDE": "tilde", "RING ABOVE": "ring", "CEDILLA": "cedilla", "CARON": "caron", "BREVE": "breve", "MACRON": "macron", "OGONEK": "ogonek", "DOT ABOVE": "dotaccent", "DOUBLE ACUTE": "hungarumlaut"}
#: Glyph names of characters that no rule gives.
OTHER_NAMES = {
    "quotesingle": "'", "grave": "`", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”", "quotesinglbase": "‚", "quotedblbase": "„", "bullet": "•", "endash": "–", "emdash": "—",
    "ellipsis": "…", "fi": "ﬁ", "fl": "ﬂ", "germandbls": "ß", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "oslash": "ø", "Oslash": "Ø", "eth": "ð", "Eth": "Ð", "thorn": "þ", "Thorn": "Þ", "lslash": "ł", "Lslash": "Ł",
    "dotlessi": "ı", "Euro": "€", "cent": "¢", "sterling": "£", "currency": "¤", "yen": "¥", "florin": "ƒ", "section": "§", "copyright": "©", "registered": "®", "trademark": "™", "degree": "°", "plusminus": "±", "mu": "µ",
    "paragraph": "¶", "periodcentered": "·", "multiply": "×", "divide": "÷", "onequarter": "¼", "onehalf": "½", "threequarters": "¾", "onesuperior": "¹", "twosuperior": "²", "threesuperior": "³", "ordfeminine": "ª", "ordmasculine": "º",
    "guillemotleft": "«", "guillemotright": "»", "guilsinglleft": "‹", "guilsinglright": "›", "exclamdown": "¡", "questiondown": "¿", "brokenbar": "¦", "logicalnot": "¬", "dagger": "†", "daggerdbl": "‡", "perthousand": "‰", "minus": "−", "fraction": "⁄",
}
#: What StandardEncoding has at these codes.
STANDARD_HIGH = dict(zip(
    [*range(0xA1, 0xB0), *range(0xB1, 0xB5), *range(0xB6, 0xBE), 0xBF, *range(0xC1, 0xC9), 0xCA, 0xCB, *range(0xCD, 0xD1), 0xE1, 0xE3, *range(0xE8, 0xEC), 0xF1, 0xF5, *range(0xF8, 0xFC)],
    """exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft guilsinglleft guilsinglright fi fl
    endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls""".split(),
))


@lru_cache(1)
def name_table() -> dict[str, str]:
    """Glyph name -> character, from the ASCII names, the names of letters with marks, and OTHER_NAMES."""
    out = {name: chr(31 + k) for k, name in STANDARD_NAMES.items() if name not in ("quoteright", "quoteleft")}
    for code in range(0xC0, 0x180):
        words = unicodedata.name(chr(code), "").split(" WITH ")
        if len(words) == 2 and words[0].startswith("LATIN ") and " LETTER " in words[0] and words[1] in MARKS:
            letter = words[0].split()[-1]
            if len(letter) == 1:
                out[(letter.lower() if " SMALL " in words[0] else letter) + MARKS[words[1]]] = chr(code)
    return out | OTHER_NAMES


def character(name: str) -> int | None:
    """Unicode of a glyph name: by table, or as uniXXXX and uXXXXX."""
    plain = name.split(".")[0]
    if plain in name_table():
        return ord(name_table()[plain])
    for prefix in ("uni", "u"):
        digits = plain.removeprefix(prefix)
        if plain.startswith(prefix) and 4 <= len(digits) <= 6:
            try:
                return int(digits, 16)
            except ValueError:
                pass
    return None


@lru_cache(8)
def base_encoding(name: str) -> dict[int, str]:
    """Glyph names by code."""
    ascii_ = {31 + k: v for k, v in STANDARD_NAMES.items()}
    if name not in ("WinAnsiEncoding", "MacRomanEncoding"):
        return ascii_ | STANDARD_HIGH
    names = {c: n for n, c in name_table().items()}
    codec = "cp1252" if name == "WinAnsiEncoding" else "mac_roman"
    high = {k: names[c] for k in range(128, 256) if (c := bytes([k]).decode(codec, "replace")) in names}
    return ascii_ | {39: "quotesingle", 96: "grave"} | high


@lru_cache(1)
def fallback_face() -> Face | None:
    for path in FALLBACKS:
        if os.path.exists(path):
            try:
                with open(path, "rb") as f:
                    return open_face(f.read())
            except FontError:
                continue
    return None


@dataclass
class Font:
    """What showing text needs. Widths in thousandths of the size."""

    two_bytes: bool = False
    names: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    missing: float = 0.0
    to_cid: dict[int, int] | None = None
    to_gid: bytes | None = None
    face: Face | None = None
    embedded: bool = False
    symbolic: bool = False
    type3: dict | None = None
    matrix: tuple = (0.001, 0.0, 0.0, 0.001, 0.0, 0.0)
    procs: dict = field(default_factory=dict)
    to_unicode: dict[int, int] = field(default_factory=dict)
    glyphs: dict[int, Outline] = field(default_factory=dict)
    shown: dict[int, str] = field(default_factory=dict)

    def codes(self, text: bytes) -> list[int]:
        return [text[i] << 8 | text[i + 1] for i in range(0, len(text) - 1, 2)] if self.two_bytes else list(text)

    def cid(self, code: int) -> int:
        return code if self.to_cid is None else self.to_cid.get(code, 0)

    def width(self, code: int) -> float:
        return self.widths.get(self.cid(code) if self.two_bytes else code, self.missing)

    def gid(self, code: int) -> int:
        face = self.face
        if self.two_bytes:
            cid = self.cid(code)
            if not self.embedded:
                return face.characters.get(self.to_unicode.get(code, 0), 0)
            if self.to_gid is not None:
                return int.from_bytes(self.to_gid[2 * cid : 2 * cid + 2], "big")
            return face.cids.get(cid, 0) if face.cids else cid
        name = self.names.get(code)
        if name in face.names:
            return face.names[name]
        if self.symbolic and code in face.codes:
            return face.codes[code]
        found = character(name) if name else None
        return face.characters.get(found, 0) if found is not None and face.characters else face.codes.get(code, face.characters.get(code, 0))

    def outline(self, code: int) -> Outline:
        if code not in self.glyphs:
            self.glyphs[code] = self.face.outline(self.gid(code)) if self.face else []
        return self.glyphs[code]

    def character(self, code: int) -> str:
        """The character that a code stands for, for text extraction."""
        known = self.shown.get(code)
        if known is None:
            known = self.shown[code] = self.sought(code)
        return known

    def sought(self, code: int) -> str:
        found = self.to_unicode.get(code)
        if found is None and not self.two_bytes:
            name = self.names.get(code)
            found = character(name) if name else None
        return chr(found) if found is not None and found < 0x110000 and not 0xD800 <= found < 0xE000 else "�"


def program(doc: Document, descriptor: dict) -> Face | None:
    for key in ("FontFile", "FontFile2", "FontFile3"):
        found = doc.get(descriptor.get(key))
        if isinstance(found, Stream) and len(found.raw) <= MAX_PROGRAM:
            try:
                return open_face(doc.decoded(found))
            except (FontError, FilterError):
                pass
    return None


def stream_map(doc: Document, found) -> dict[int, int]:
    found = doc.get(found)
    if not isinstance(found, Stream):
        return {}
    try:
        return dict(cmap(doc.decoded(found)))
    except FilterError:
        return {}


#: In place of what is no font dictionary.
NO_FONT: dict = {}


def resolve_once(doc: Document, info: dict) -> Font:
    """The same font for all pages and tables of a document."""
    if id(info) not in doc.fonts:
        doc.fonts[id(info)] = info, resolve(doc, info)  # held with it, so that no other takes its place
    return doc.fonts[id(info)][1]


def resolve(doc: Document, info: dict) -> Font:
    """From a font dictionary of any kind."""
    info = {k: doc.get(v) for k, v in info.items()}
    out = Font(to_unicode=stream_map(doc, info.get("ToUnicode")))
    kind = info.get("Subtype")
    if kind == "Type0":
        composite(doc, info, out)
    else:
        simple(doc, info, out)
    if kind == "Type3":
        out.type3 = info
        matrix = [doc.get(v) for v in info.get("FontMatrix") or []]
        out.matrix = tuple(map(float, matrix)) if len(matrix) == 6 else out.matrix
        out.procs = info.get("CharProcs") or {}
    elif out.face is None:
        out.face = fallback_face()
    return out


def simple(doc: Document, info: dict, out: Font) -> None:
    descriptor = info.get("FontDescriptor") or {}
    out.face = program(doc, descriptor)
    out.embedded = out.face is not None
    out.symbolic = bool(as_int(doc.get(descriptor.get("Flags"))) & 4)
    out.missing = float(as_int(doc.get(descriptor.get("MissingWidth"))))
    first, widths = as_int(info.get("FirstChar")), info.get("Widths") or []
    if all(v.__class__ is int or v.__class__ is float for v in widths):  # as they are in most
        out.widths = dict(enumerate(map(float, widths), first))
    else:
        out.widths = {first + k: float(w) for k, v in enumerate(widths) if isinstance(w := doc.get(v), (int, float))}
    encoding = info.get("Encoding")
    if isinstance(encoding, dict):
        base = doc.get(encoding.get("BaseEncoding"))
        changes = [doc.get(v) for v in doc.get(encoding.get("Differences")) or []]
        out.names = differences(base_encoding(str(base)), changes)
    elif isinstance(encoding, Name) or not out.symbolic:
        out.names = base_encoding(str(encoding))
    if not out.widths and info.get("Subtype") != "Type3":
        face = out.face or fallback_face()
        if face:  # a font of the standard ones: the face's own advances
            own, out.face = out.face, face
            out.widths = {c: w for c in range(256) if (w := face.advance(out.gid(c))) is not None}
            out.face = own


def composite(doc: Document, info: dict, out: Font) -> None:
    out.two_bytes = True
    below = [doc.get(v) for v in info.get("DescendantFonts") or []]
    cid_font = {k: doc.get(v) for k, v in below[0].items()} if below and isinstance(below[0], dict) else {}
    encoding = info.get("Encoding")
    out.to_cid = stream_map(doc, encoding) if isinstance(encoding, Stream) else None
    out.missing = float(cid_font.get("DW", 1000))
    w = [[doc.get(x) for x in v] if isinstance(v, list) else v for v in map(doc.get, cid_font.get("W") or [])]
    for _, first, last, widths in reversed(cid_widths(w)):
        out.widths |= {c: float(widths[c - first] if len(widths) > 1 else widths[0]) for c in range(first, last + 1) if widths}
    out.face = program(doc, cid_font.get("FontDescriptor") or {})
    out.embedded = out.face is not None
    to_gid = cid_font.get("CIDToGIDMap")
    if isinstance(to_gid, Stream):
        try:
            out.to_gid = doc.decoded(to_gid)[:MAX_CID_MAP]
        except FilterError:
            pass
