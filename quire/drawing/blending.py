"""Blend modes and group compositing on byte arrays, with the rounding of the Column versions
in :mod:`quire.functions.blend`."""

from __future__ import annotations

import numpy as np


def div255(x: np.ndarray) -> np.ndarray:
    return np.minimum((x + (x >> 8) + 128) >> 8, 255)


def toward_zero(a: np.ndarray, b) -> np.ndarray:
    return np.sign(a) * (np.abs(a) // b)


def overlay(s, d):
    return np.where(d < 128, div255(2 * s * d), 255 - div255(2 * (255 - s) * (255 - d)))


def soft_light(s, d):
    dark = d - toward_zero((255 - 2 * s) * d * (255 - d), 255 * 255)
    curve = np.where(d < 64, toward_zero((toward_zero((16 * d - 12 * 255) * d, 255) + 4 * 255) * d, 255), np.sqrt(255.0 * d).astype("i4"))
    return np.clip(np.where(s < 128, dark, d + toward_zero((2 * s - 255) * (curve - d), 255)), 0, 255)


SEPARABLE = {
    "Multiply": lambda s, d: div255(s * d),
    "Screen": lambda s, d: s + d - div255(s * d),
    "Overlay": overlay,
    "Darken": np.minimum,
    "Lighten": np.maximum,
    "ColorDodge": lambda s, d: np.where(s == 255, 255, np.minimum(255 * d // np.maximum(255 - s, 1), 255)),
    "ColorBurn": lambda s, d: np.where(s == 0, 0, np.maximum(255 - 255 * (255 - d) // np.maximum(s, 1), 0)),
    "HardLight": lambda s, d: overlay(d, s),
    "SoftLight": soft_light,
    "Difference": lambda s, d: np.abs(s - d),
    "Exclusion": lambda s, d: np.maximum(s + d - div255(2 * s * d), 0),
}


def luma(c: np.ndarray) -> np.ndarray:
    return (77 * c[..., 0] + 151 * c[..., 1] + 28 * c[..., 2] + 128) >> 8


def with_luma(c: np.ndarray, target: np.ndarray) -> np.ndarray:
    c = c + (target - luma(c))[..., None]
    lum, low, high = luma(c)[..., None], c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    under = np.clip(lum + toward_zero((c - lum) * lum, np.maximum(lum - low, 1)), 0, 255)
    over = np.clip(lum + toward_zero((c - lum) * (255 - lum), np.maximum(high - lum, 1)), 0, 255)
    return np.where(low < 0, under, np.where(high > 255, over, c))


def with_saturation(c: np.ndarray, sat: np.ndarray) -> np.ndarray:
    low, high = c.min(axis=-1, keepdims=True), c.max(axis=-1, keepdims=True)
    return np.where(high > low, (c - low) * sat[..., None] // np.maximum(high - low, 1), 0)


def saturation(c: np.ndarray) -> np.ndarray:
    return c.max(axis=-1) - c.min(axis=-1)


WHOLE = {
    "Hue": lambda s, d: with_luma(with_saturation(s, saturation(d)), luma(d)),
    "Saturation": lambda s, d: with_luma(with_saturation(d, saturation(s)), luma(d)),
    "Color": lambda s, d: with_luma(s, luma(d)),
    "Luminosity": lambda s, d: with_luma(d, luma(s)),
}
MODES = frozenset(("Normal", "Compatible", *SEPARABLE, *WHOLE))


def blended(mode: str, s: np.ndarray, d: np.ndarray) -> np.ndarray:
    """(n, 3) colours; an unknown mode is Normal."""
    f = SEPARABLE.get(mode) or WHOLE.get(mode)
    return f(s, d) if f else s


def composite(mode: str, s: np.ndarray, a_s: np.ndarray, d: np.ndarray, a_d: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """(colours, alphas) of a paint over a destination, with or without an alpha plane."""
    s, d, a = s.astype("i4"), d.astype("i4"), a_s.astype("i4")[:, None]
    x = blended(mode, s, d)
    if a_d is None:
        return div255((255 - a) * d + a * x), None
    b = a_d.astype("i4")[:, None]
    result = np.minimum(a + b - div255(a * b), 255)
    top = a * s if x is s else a * ((255 - b) * s + b * x) // 255
    return np.where(result == 0, 0, np.clip(((result - a) * d + top) // np.maximum(result, 1), 0, 255)), result[:, 0]
