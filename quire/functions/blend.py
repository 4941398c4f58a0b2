"""The sixteen blend modes and the ways of laying one pixel over another, on bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.color import clamp, div, div255, let, long, luma_blend

Rgb = tuple[Column, Column, Column]


def normal(s: Column, d: Column) -> Column:
    return s


def multiply(s: Column, d: Column) -> Column:
    return div255(s * d)


def screen(s: Column, d: Column) -> Column:
    return s + d - div255(s * d)


def overlay(s: Column, d: Column) -> Column:
    return F.when(d < 128, div255(2 * s * d)).otherwise(255 - div255(2 * (255 - s) * (255 - d)))


def darken(s: Column, d: Column) -> Column:
    return F.least(s, d)


def lighten(s: Column, d: Column) -> Column:
    return F.greatest(s, d)


def color_dodge(s: Column, d: Column) -> Column:
    return F.when(s == 255, long(255)).otherwise(F.least(div(255 * d, F.greatest(255 - s, long(1))), long(255)))


def color_burn(s: Column, d: Column) -> Column:
    return F.when(s == 0, long(0)).otherwise(F.greatest(255 - div(255 * (255 - d), F.greatest(s, long(1))), long(0)))


def hard_light(s: Column, d: Column) -> Column:
    return overlay(d, s)


def soft_light(s: Column, d: Column) -> Column:
    """In whole numbers: every quotient drops its remainder."""
    dark = d - div((255 - 2 * s) * d * (255 - d), 255 * 255)
    curve = F.when(d < 64, div((div((16 * d - 12 * 255) * d, 255) + 4 * 255) * d, 255)).otherwise(F.floor(F.sqrt((255 * d).cast("double"))).cast("long"))
    return clamp(F.when(s < 128, dark).otherwise(d + div((2 * s - 255) * (curve - d), 255)), 0, 255)


def difference(s: Column, d: Column) -> Column:
    return F.abs(s - d)


def exclusion(s: Column, d: Column) -> Column:
    return F.greatest(s + d - div255(2 * s * d), long(0))


SEPARABLE = {
    "normal": normal, "multiply": multiply, "screen": screen, "overlay": overlay, "darken": darken, "lighten": lighten,
    "color_dodge": color_dodge, "color_burn": color_burn, "hard_light": hard_light, "soft_light": soft_light,
    "difference": difference, "exclusion": exclusion,
}


def saturation(c: Rgb) -> Column:
    return F.greatest(*c) - F.least(*c)


def rgb_struct(c: Rgb) -> Column:
    return F.struct(*[long(x).alias(n) for x, n in zip(c, "rgb")])


def channels(c: Column) -> Rgb:
    return c["r"], c["g"], c["b"]


def clip_color(c: Column) -> Column:
    """An rgb struct back into 0..255 at the same luminosity."""

    def limited(x: Column) -> Column:
        lum, low, high = x["lum"], x["low"], x["high"]
        under, over = F.greatest(lum - low, long(1)), F.greatest(high - lum, long(1))
        return rgb_struct(
            tuple(
                F.when(low < 0, clamp(lum + div((v - lum) * lum, under), 0, 255)).when(high > 255, clamp(lum + div((v - lum) * (255 - lum), over), 0, 255)).otherwise(v)
                for v in channels(x["c"])
            )
        )

    return let(c, lambda v: let(F.struct(v.alias("c"), luma_blend(*channels(v)).alias("lum"), F.least(*channels(v)).alias("low"), F.greatest(*channels(v)).alias("high")), limited))


def set_luminosity(c: Column, luminosity: Column) -> Column:
    def moved(x: Column) -> Column:
        return clip_color(rgb_struct(tuple(v + x["shift"] for v in channels(x["c"]))))

    return let(c, lambda v: let(F.struct(v.alias("c"), (luminosity - luma_blend(*channels(v))).alias("shift")), moved))


def set_saturation(c: Rgb, sat: Column) -> Column:
    low, high = F.least(*c), F.greatest(*c)
    return rgb_struct(tuple(F.when(high > low, div((x - low) * sat, F.greatest(high - low, long(1)))).otherwise(long(0)) for x in c))


def hue(s: Rgb, d: Rgb) -> Column:
    return set_luminosity(set_saturation(s, saturation(d)), luma_blend(*d))


def saturate(s: Rgb, d: Rgb) -> Column:
    return set_luminosity(set_saturation(d, saturation(s)), luma_blend(*d))


def color(s: Rgb, d: Rgb) -> Column:
    return set_luminosity(rgb_struct(s), luma_blend(*d))


def luminosity(s: Rgb, d: Rgb) -> Column:
    return set_luminosity(rgb_struct(d), luma_blend(*s))


#: Each gives a struct of r, g and b.
NON_SEPARABLE = {"hue": hue, "saturation": saturate, "color": color, "luminosity": luminosity}


# Three ways to lay a source over a destination, which round differently.


def over_rounded(s: Column, d: Column, a: Column) -> Column:
    return div255((255 - a) * d + a * s)


def over_truncated(s: Column, d: Column, a: Column) -> Column:
    return div(s * a + d * (255 - a), 255)


def over_rgba(s: Column, sa: Column, d: Column, da: Column) -> tuple[Column, Column]:
    """(colour, alpha) with straight alpha on both sides."""
    rest = div(da * (255 - sa) + 127, 255)
    alpha = sa + rest
    return F.when(alpha == 0, long(0)).otherwise(F.least(div(s * sa + d * rest + div(alpha, 2), F.greatest(alpha, long(1))), long(255))), alpha


def soft_mask(value: Column, mask: Column) -> Column:
    return div(value * mask + 127, 255)


def overprint(s: Column, d: Column, channel: int, mask: Column, additive: Column) -> Column:
    """A channel whose bit is not in the mask keeps its destination; additive paint adds up."""
    painted = F.when(additive, F.least(s + d, long(255))).otherwise(s)
    return F.when(mask.bitwiseAND(1 << channel) != 0, painted).otherwise(d)


def shape_alpha(alpha: Column, shape: Column | None = None, mask: Column | None = None) -> Column:
    if mask is not None:
        alpha = div255(alpha * mask)
    return alpha if shape is None else div255(alpha * shape)


def group_alphas(a_s: Column, a_d: Column, shape: Column, knockout: bool, backdrop: Column | None = None) -> tuple[Column, Column, Column]:
    """(result, alpha_i, alpha_i-1) of a paint in a transparency group."""
    cap = lambda x: F.least(x, long(255))
    result = cap(a_s + div255(a_d * (255 - shape))) if knockout else cap(a_s + a_d - div255(a_s * a_d))
    if backdrop is None:
        return result, result, long(0) if knockout else a_d
    here = cap(result + backdrop - div255(result * backdrop))
    return result, here, backdrop if knockout else cap(backdrop + a_d - div255(backdrop * a_d))


def group_color(c_s: Column, c_d: Column, blended: Column | None, a_s: Column, alphas: tuple[Column, Column, Column]) -> Column:
    result, here, before = alphas
    top = a_s * c_s if blended is None else div(a_s * ((255 - before) * c_s + before * blended), 255)
    return F.when(result == 0, long(0)).otherwise(div((here - a_s) * c_d + top, F.greatest(here, long(1))))
