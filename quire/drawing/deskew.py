"""The skew of a scanned page, and its removal."""

from __future__ import annotations

import numpy as np

ANGLES = 56
WIDEST = 7.0
FINEST, LEAST_TURN = 0.01, 0.05


def reduced(gray: np.ndarray) -> np.ndarray:
    """Means of whole 4 x 4 blocks, remainders dropped."""
    h, w = gray.shape[0] // 4, gray.shape[1] // 4
    return gray[: 4 * h, : 4 * w].reshape(h, 4, w, 4).astype("i8").sum(axis=(1, 3)) // 16


def score(small: np.ndarray, degrees: float) -> float:
    """Squared differences of neighbouring rows of ink, sheared by the angle."""
    h, w = small.shape
    tangent = np.tan(np.float32(np.radians(np.float32(degrees))))
    n = h + int(np.ceil(w * abs(tangent)))
    shift = np.floor(np.arange(w, dtype="f4") * tangent + np.float32(0.5)).astype("i8")
    rows = np.clip(np.arange(h)[:, None] + shift[None, :], 0, n - 1)
    ink = np.bincount(rows.ravel(), weights=(255 - small).ravel(), minlength=n)
    edge = max(h // 20, 1)
    return float((np.diff(ink)[edge - 1 : n - edge - 1] ** 2).sum()) if n > 2 * edge else 0.0


def angle(gray: np.ndarray) -> float:
    """Degrees by which the lines of a page run off; 0 where nothing is to be told."""
    if min(gray.shape) < 8:
        return 0.0
    small = reduced(gray)
    step = 2 * WIDEST / (ANGLES - 1)
    tried = [-WIDEST + step * k for k in range(ANGLES)]
    scores = [score(small, a) for a in tried]
    best = int(np.argmax(scores))
    if scores[best] < 0.01 * small.size:
        return 0.0
    centre, delta = tried[best], step / 2
    while delta >= FINEST:
        left, right = score(small, centre - delta), score(small, centre + delta)
        centre = centre + delta if right > left else centre - delta
        delta /= 2
    return centre


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle, bilinear; what comes from outside is white."""
    h, w = gray.shape
    cy, cx, t = (h - 1) / 2, (w - 1) / 2, np.radians(degrees)
    y, x = np.mgrid[0:h, 0:w]
    sx, sy = np.cos(t) * (x - cx) - np.sin(t) * (y - cy) + cx, np.sin(t) * (x - cx) + np.cos(t) * (y - cy) + cy
    x0, y0 = np.floor(sx).astype("i8"), np.floor(sy).astype("i8")
    inside = (x0 >= 0) & (x0 <= w - 2) & (y0 >= 0) & (y0 <= h - 2)
    x0, y0 = np.where(inside, x0, 0), np.where(inside, y0, 0)
    fx, fy, g = sx - x0, sy - y0, gray.astype("f8")
    if h < 2 or w < 2:
        return np.full_like(gray, 255)
    mixed = (g[y0, x0] * (1 - fx) + g[y0, x0 + 1] * fx) * (1 - fy) + (g[y0 + 1, x0] * (1 - fx) + g[y0 + 1, x0 + 1] * fx) * fy
    return np.where(inside, np.clip(np.floor(mixed + 0.5), 0, 255), 255).astype(np.uint8)


def straightened(gray: np.ndarray) -> tuple[np.ndarray, float]:
    """(page, angle that was taken out)."""
    found = angle(gray)
    return (gray, 0.0) if abs(found) < LEAST_TURN else (rotated(gray, -found), found)
