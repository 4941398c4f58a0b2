"""Image objects to samples: colour spaces, Decode arrays, masks, codecs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from quire.drawing import ccitt, jbig2
from quire.drawing.numbers import function
from quire.sources.filters import FilterError
from quire.sources.jpeg import JpegError
from quire.sources.jpeg import decode as decode_jpeg
from quire.sources.pdf import Document, Name, Stream, as_int

MAX_SIDE, MAX_SPACE_DEPTH = 65_536, 8
#: Codecs that this engine has no decoder for: their images fail by name.
UNSUPPORTED = ("JPXDecode",)
#: codec -> (bytes, image's dictionary, parameters) -> (h, w, n) bytes, or (h, w) bits. More can be registered.
CODECS: dict[str, Callable] = {
    "DCTDecode": lambda data, info, parms: decode_jpeg(data),
    "CCITTFaxDecode": lambda data, info, parms: ccitt.decode(
        data, as_int(parms.get("Columns"), 1728), as_int(parms.get("Rows")) or as_int(info.get("Height")), as_int(parms.get("K")), bool(parms.get("BlackIs1")), bool(parms.get("EncodedByteAlign"))
    ),
    "JBIG2Decode": lambda data, info, parms: jbig2.decode(data, parms.get("JBIG2Globals") or b"", as_int(info.get("Width")), as_int(info.get("Height"))),
}


class ImageError(ValueError):
    """``kind``: DecodeFailed, Unsupported or BadDimensions."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}")
        self.kind = kind


@dataclass(frozen=True)
class Space:
    """``rgb`` takes (n, components) floats, 0 to 1 (indexes for Indexed), to (n, 3) bytes."""

    family: str
    n: int
    rgb: Callable[[np.ndarray], np.ndarray]
    top: float = 1.0  # of Decode's default range


def bytes_of(x: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(x, 0, 1) * 255 + 0.5).astype("i4")


def gray_rgb(x):
    return np.repeat(bytes_of(x[:, :1]), 3, axis=1)


def cmyk_rgb(x):
    v = bytes_of(x)
    return ((255 - v[:, :3]) * (255 - v[:, 3:4]) + 127) // 255


def lab_rgb(x, ranges):
    """D65 Lab of L 0 to 100 and a, b in their ranges (given as 0 to 1)."""
    lightness = x[:, 0] * 100
    a, b = (ranges[2 * k] + x[:, k + 1] * (ranges[2 * k + 1] - ranges[2 * k]) for k in range(2))
    fy = (lightness + 16) / 116
    f = np.stack([fy + a / 500, fy, fy - b / 200], axis=1)
    t = np.where(f > 6 / 29, f**3, (f - 4 / 29) * 3 * (6 / 29) ** 2) * np.array([0.95047, 1.0, 1.08883])
    linear = np.clip(t @ np.array([[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.204, 1.057]]).T, 0, 1)
    return bytes_of(np.where(linear <= 0.0031308, 12.92 * linear, 1.055 * linear ** (1 / 2.4) - 0.055))


GRAY = Space("DeviceGray", 1, gray_rgb)
RGB = Space("DeviceRGB", 3, lambda x: bytes_of(x[:, :3]))
CMYK = Space("DeviceCMYK", 4, cmyk_rgb)
DEVICE = {"DeviceGray": GRAY, "G": GRAY, "CalGray": GRAY, "DeviceRGB": RGB, "RGB": RGB, "CalRGB": RGB, "DeviceCMYK": CMYK, "CMYK": CMYK}
BY_COUNT = {1: GRAY, 3: RGB, 4: CMYK}


def space_of(doc: Document, found, resources: dict | None = None, depth: int = 0) -> Space:
    """A name, or an array of a family and its parameters; what can't be resolved is gray."""
    found = doc.get(found)
    if isinstance(found, str) and not isinstance(found, bytes):
        if found in DEVICE:
            return DEVICE[found]
        named = (doc.get((resources or {}).get("ColorSpace")) or {}).get(found)
        if found == "Pattern":
            return Space("Pattern", 0, gray_rgb)
        return space_of(doc, named, None, depth + 1) if named is not None and depth < MAX_SPACE_DEPTH else GRAY
    if not isinstance(found, list) or not found or depth > MAX_SPACE_DEPTH:
        return GRAY
    family, rest = str(doc.get(found[0])), [doc.get(v) for v in found[1:]]
    if family in DEVICE:
        return DEVICE[family]
    try:
        if family == "ICCBased":
            return BY_COUNT.get(as_int(doc.get(rest[0].info.get("N"))), GRAY)
        if family == "Lab":
            ranges = [float(doc.get(v)) for v in doc.get(rest[0].get("Range")) or [-100, 100, -100, 100]]
            return Space("Lab", 3, lambda x: lab_rgb(x, ranges))
        if family in ("Indexed", "I"):
            return indexed(doc, space_of(doc, found[1], resources, depth + 1), as_int(rest[1]), rest[2])
        if family in ("Separation", "DeviceN"):
            n = len(rest[0]) if isinstance(rest[0], list) else 1
            return tinted(family, n, space_of(doc, found[2], resources, depth + 1), function(doc, found[3]), rest[0])
        if family == "Pattern":
            base = space_of(doc, found[1], resources, depth + 1) if rest else GRAY
            return Space("Pattern", base.n if rest else 0, base.rgb)
    except (AttributeError, IndexError, TypeError, ValueError):
        pass
    return GRAY


def indexed(doc: Document, base: Space, most: int, lookup) -> Space:
    raw = doc.decoded(lookup) if isinstance(lookup, Stream) else lookup if isinstance(lookup, bytes) else b""
    most = min(max(most, 0), 255)
    table = np.frombuffer(raw[: (most + 1) * base.n].ljust((most + 1) * base.n, b"\0"), np.uint8).reshape(-1, base.n) / 255
    palette = base.rgb(table)
    return Space("Indexed", 1, lambda x: palette[np.clip(x[:, 0].astype("i8"), 0, most)], 0.0)


def tinted(family: str, n: int, base: Space, tint, names) -> Space:
    """Through the tint function; without one the first component is ink on white. None paints nothing."""
    if tint is None:
        return Space(family, n, lambda x: gray_rgb(1 - x[:, :1]))
    return Space(family, n, lambda x: base.rgb(tint(x.T[:n]).T))


def raw_samples(data: bytes, width: int, height: int, n: int, bits: int) -> np.ndarray:
    """(height, width, n) whole numbers; missing rows are zero."""
    if bits not in (1, 2, 4, 8, 16):
        raise ImageError("DecodeFailed", f"{bits} bits")
    stride = (width * n * bits + 7) // 8
    raw = np.frombuffer(data[: stride * height].ljust(stride * height, b"\0"), np.uint8).reshape(height, stride)
    if bits == 16:
        values = raw[:, ::2].astype("i4") << 8 | raw[:, 1::2]
    elif bits == 8:
        values = raw
    else:
        values = (raw[:, :, None] >> (np.arange(8 // bits - 1, -1, -1) * bits) & ((1 << bits) - 1)).reshape(height, -1)
    return values[:, : width * n].reshape(height, width, n)


@dataclass
class Image:
    """``rgb`` (h, w, 3) bytes and ``alpha`` (h, w) bytes or None; of a stencil only alpha."""

    rgb: np.ndarray | None
    alpha: np.ndarray | None
    filter: str = "Raw"


def decode_samples(doc: Document, stream: Stream, info: dict, n: int, bits: int) -> tuple[np.ndarray, int, str]:
    """((h, w, components) samples, bits of a sample, codec)."""
    width, height = as_int(info.get("Width")), as_int(info.get("Height"))
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE):
        raise ImageError("BadDimensions", f"{width} x {height}")
    try:
        data, codec = doc.decoded_as(stream)
        if codec is None:
            return raw_samples(data, width, height, n, bits), bits, "Raw"
        if codec not in CODECS:
            raise ImageError("Unsupported", codec)
        parms = doc.get(info.get("DecodeParms"))
        parms = doc.get(parms[-1]) if isinstance(parms, list) and parms else parms
        found = {k: doc.get(v) for k, v in (parms or {}).items()}
        out = CODECS[codec](data, info, {k: doc.decoded(v) if isinstance(v, Stream) else v for k, v in found.items()})
        return (out[:, :, None], 1, codec) if out.ndim == 2 else (out, 8, codec)
    except (FilterError, JpegError, jbig2.Jbig2Error, IndexError) as e:
        raise ImageError("DecodeFailed", str(e)) from None


def resolve(doc: Document, stream: Stream, resources: dict | None = None, depth: int = 0) -> Image:
    """The samples of an image, with its soft mask, stencil mask or colour key as alpha."""
    info = {k: doc.get(v) for k, v in stream.info.items()}
    stencil = info.get("ImageMask") is True
    space = GRAY if stencil or "ColorSpace" not in info else space_of(doc, info["ColorSpace"], resources)
    raw, bits, codec = decode_samples(doc, stream, info, space.n, 1 if stencil else as_int(info.get("BitsPerComponent"), 8))
    decode = [float(v) for v in (doc.get(x) for x in info.get("Decode") or []) if isinstance(v, (int, float))]
    if stencil:
        paints = 1 if decode[:1] == [1.0] else 0
        return Image(None, np.where(raw[:, :, 0] == paints, 255, 0).astype(np.uint8), codec)
    h, w, n = raw.shape
    if n != space.n:
        space, decode = BY_COUNT.get(n, GRAY), []
    top = (1 << bits) - 1
    flat = raw.reshape(-1, n).astype("f8")
    if len(decode) >= 2 * n:
        low, high = np.array(decode[: 2 * n : 2]), np.array(decode[1 : 2 * n : 2])
        flat = low + flat * (high - low) / top
    elif space.top:
        flat = flat / top
    rgb = np.clip(space.rgb(flat), 0, 255).astype(np.uint8).reshape(h, w, 3)
    return Image(rgb, alpha_of(doc, info, raw, depth), codec)


def alpha_of(doc: Document, info: dict, raw: np.ndarray, depth: int) -> np.ndarray | None:
    """A soft mask goes before a mask; either is scaled to the image by nearest samples."""
    h, w, n = raw.shape
    soft, mask = info.get("SMask"), info.get("Mask")
    try:
        if isinstance(soft, Stream) and depth == 0:
            return scaled(resolve(doc, soft, None, 1).rgb[:, :, 0], w, h)
        if isinstance(mask, Stream) and depth == 0:
            return scaled(resolve(doc, Stream({**mask.info, "ImageMask": True}, mask.raw), None, 1).alpha, w, h)
    except (ImageError, TypeError):
        return None
    if isinstance(mask, list) and len(mask) >= 2 * n:
        keys = [as_int(doc.get(v)) for v in mask]
        hidden = np.logical_and.reduce([(raw[:, :, k] >= keys[2 * k]) & (raw[:, :, k] <= keys[2 * k + 1]) for k in range(n)])
        return np.where(hidden, 0, 255).astype(np.uint8)
    return None


def scaled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    h, w = plane.shape
    return plane if (h, w) == (height, width) else plane[np.arange(height) * h // height][:, np.arange(width) * w // width]


def box_scaled(plane: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the source pixels under each target pixel (nearest where it grows)."""
    h, w = plane.shape[:2]

    def axis(x: np.ndarray, source: int, target: int, along: int) -> np.ndarray:
        if target >= source:
            return np.take(x, np.arange(target) * source // target, axis=along)
        edges = np.arange(target) * source // target
        sizes = np.diff(np.append(edges, source))
        shape = [1] * x.ndim
        shape[along] = target
        return np.add.reduceat(x, edges, axis=along) / sizes.reshape(shape)

    return np.floor(axis(axis(plane.astype("f8"), h, height, 0), w, width, 1) + 1e-9).astype(np.uint8)


def placed(matrix: tuple, width: int, height: int, image: Image) -> tuple[slice, slice, np.ndarray, np.ndarray, np.ndarray] | None:
    """(rows, columns, inside, source rows, source columns) of the device pixels whose centres lie in
    the image's unit square under ``matrix``."""
    a, b, c, d, e, f = matrix
    det = a * d - b * c
    xs, ys = [e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d]
    if not det or not all(map(np.isfinite, xs + ys)):
        return None
    x0, x1 = max(0, int(np.floor(min(xs)))), min(width, int(np.ceil(max(xs))) + 1)
    y0, y1 = max(0, int(np.floor(min(ys)))), min(height, int(np.ceil(max(ys))) + 1)
    if x0 >= x1 or y0 >= y1:
        return None
    py, px = np.mgrid[y0:y1, x0:x1] + 0.5
    u, t = ((px - e) * d - (py - f) * c) / det, ((py - f) * a - (px - e) * b) / det
    inside = (u >= 0) & (u < 1) & (t >= 0) & (t < 1)
    h, w = (image.rgb if image.rgb is not None else image.alpha).shape[:2]
    ix, iy = np.clip((u * w).astype("i8"), 0, w - 1), np.clip(((1 - t) * h).astype("i8"), 0, h - 1)
    return slice(y0, y1), slice(x0, x1), inside, iy, ix


def name_of_filter(doc: Document, info: dict, known: tuple[str, ...]) -> str:
    """The terminal filter, Raw if there is none or it is unknown."""
    name = doc.get(info.get("Filter"))
    name = doc.get(name[-1]) if isinstance(name, list) and name else name
    return str(name) if isinstance(name, Name) and name in known else "Raw"
