"""Integer colour arithmetic as Column functions. Channels are 0..255 in BIGINT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def long(x: Column | int) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def div(a: Column | int, b: Column | int) -> Column:
    """Integer division that drops the remainder, toward zero."""
    return F.call_function("div", long(a), long(b))


def clamp(x: Column, low: Column | int, high: Column | int) -> Column:
    return F.least(F.greatest(x, long(low)), long(high))


def div255(x: Column) -> Column:
    """x / 255, rounded, at most 255."""
    return F.least(F.shiftright(x + F.shiftright(x, 8) + 128, 8), long(255))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """From a (t = 0) to b (t = 256)."""
    return div255(a * (256 - t) + b * t)


def cmyk_saturating(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    return tuple(F.greatest(255 - x - k, long(0)) for x in (c, m, y))


def cmyk_reflectance(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    return tuple(div((255 - x) * (255 - k) + 127, 255) for x in (c, m, y))


def unit_to_byte(v: Column) -> Column:
    """0.0..1.0, clamped, to 0..255; halves go away from zero."""
    return F.round(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255).cast("long")


def saturated(x: Column) -> Column:
    """To the range of a 32-bit integer."""
    return clamp(x, -(1 << 31), (1 << 31) - 1)


def floor_int(x: Column) -> Column:
    return saturated(F.floor(x).cast("long"))


def ceil_int(x: Column) -> Column:
    return saturated(F.ceil(x).cast("long"))


def round_int(x: Column) -> Column:
    """Halves go up."""
    return saturated(F.floor(x + 0.5).cast("long"))


def luma_output(r: Column, g: Column, b: Column) -> Column:
    """Gray of an output page."""
    return div(2126 * r + 7152 * g + 722 * b + 5000, 10000)


def luma_blend(r: Column, g: Column, b: Column) -> Column:
    """Gray in blend modes and soft masks."""
    return F.shiftright(77 * r + 151 * g + 28 * b + 128, 8)


def mono(gray: Column) -> Column:
    """Ink where the gray is below the middle."""
    return F.when(gray < 128, long(255)).otherwise(long(0))


def lab_to_srgb(lightness: Column, a: Column, b: Column) -> tuple[Column, ...]:
    """CIE L*a*b* (D65) to sRGB bytes."""
    fy = (lightness + 16) / 116

    def inverse(t: Column) -> Column:
        return F.when(t > F.lit(6.0 / 29.0), t * t * t).otherwise((t - F.lit(4.0 / 29.0)) * F.lit(3 * (6.0 / 29.0) ** 2))

    x, y, z = (inverse(t) * white for t, white in ((fy + a / 500, 0.95047), (fy, 1.0), (fy - b / 200, 1.08883)))
    linear = (
        3.2406 * x - 1.5372 * y - 0.4986 * z,
        -0.9689 * x + 1.8758 * y + 0.0415 * z,
        0.0557 * x - 0.204 * y + 1.057 * z,
    )

    def gamma(v: Column) -> Column:
        v = F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))
        return F.when(v <= 0.0031308, v * F.lit(12.92)).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)

    return tuple(unit_to_byte(gamma(v)) for v in linear)


# Transfer tables: 256 numbers, applied to a channel.


def identity_table() -> Column:
    return F.sequence(F.lit(0), F.lit(255))


def inverted_table() -> Column:
    return F.sequence(F.lit(255), F.lit(0))


def apply_table(table: Column, value: Column) -> Column:
    return F.get(table, value.cast("int")).cast("long")


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def compose_tables(first: Column, second: Column) -> Column:
    """What second does to the results of first."""
    return let(second, lambda t: F.transform(first, lambda v: F.get(t, v)))


def invert_complement(table: Column) -> Column:
    """The table for the complement of a channel, as CMYK needs it of RGB."""
    return let(table, lambda t: F.transform(F.sequence(F.lit(255), F.lit(0)), lambda i: F.lit(255) - F.get(t, i)))


#: Mode: (components, bits of a pixel, bytes of a pixel).
PIXEL_MODES = {"Mono1": (1, 1, 0), "Mono8": (1, 8, 1), "Rgb8": (3, 24, 3), "Bgr8": (3, 24, 3), "Xbgr8": (4, 32, 4), "Cmyk8": (4, 32, 4), "DeviceN8": (8, 64, 8)}


def pixel_bits(mode: Column) -> Column:
    found = F.lit(None).cast("long")
    for name, (_, bits, _) in PIXEL_MODES.items():
        found = F.when(mode == name, long(bits)).otherwise(found)
    return found


def row_bytes(mode: Column, width: Column) -> Column:
    return div(width * pixel_bits(mode) + 7, 8)


def coordinates_to_gray(space: Column, c: list[Column]) -> Column:
    """Gray byte of 0..1 components of a device colour space; None of them is black."""
    rgb = F.when(space == "DeviceRGB", luma_output(*(unit_to_byte(x) for x in c[:3])))
    cmyk = luma_output(*cmyk_reflectance(*(unit_to_byte(x) for x in c)))
    return rgb.when(space == "DeviceGray", unit_to_byte(c[0])).when(space == "DeviceCMYK", cmyk).otherwise(long(0))
