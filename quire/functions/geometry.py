"""Matrices, boxes, page sizes and resolutions as Column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolutions that pages are rendered at.
DPI_STEPS = (72, 96, 150, 200, 300, 400, 600)
MAX_SIDE, MAX_AREA = 32_768, 600_000_000


def matrix_product(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    """First a, then b, of matrices [a b c d e f] on row vectors."""
    return (
        a[0] * b[0] + a[1] * b[2],
        a[0] * b[1] + a[1] * b[3],
        a[2] * b[0] + a[3] * b[2],
        a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4],
        a[4] * b[1] + a[5] * b[3] + b[5],
    )


def transform(m: Sequence[Column], x: Column, y: Column) -> tuple[Column, Column]:
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def to_device(m: Sequence[Column], x: Column, y: Column, height: Column) -> tuple[Column, Column]:
    """Through the matrix, then with y counted from the page's top."""
    u, v = transform(m, x, y)
    return u, height - v


def normalized_box(x0: Column, y0: Column, x1: Column, y1: Column) -> tuple[Column, ...]:
    return F.least(x0, x1), F.least(y0, y1), F.greatest(x0, x1), F.greatest(y0, y1)


def box_intersection(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, ...]:
    """The common part, or all of ``a`` if they have none."""
    both = F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3])
    real = (both[0] < both[2]) & (both[1] < both[3])
    return tuple(F.when(real, x).otherwise(y) for x, y in zip(both, a))


def page_pixels(width_pts: Column, height_pts: Column, dpi: Column) -> tuple[Column, Column]:
    scale = dpi / 72
    return F.floor(width_pts * scale + 0.5).cast("long"), F.floor(height_pts * scale + 0.5).cast("long")


def page_error(width: Column, height: Column) -> Column:
    """Kind of error of a page's size in pixels, or null."""
    return (
        F.when((width <= 0) | (height <= 0), "PageDegenerate")
        .when((width > MAX_SIDE) | (height > MAX_SIDE), "PageTooLarge")
        .when(width * height > MAX_AREA, "PageAreaTooLarge")
    )


def suggested_dpi(ppi: Column, low: float = 72, high: float = 600) -> Column:
    """The first step that is at least ``ppi``, within bounds; null stays null."""
    found = F.lit(float(DPI_STEPS[-1]))
    for step in reversed(DPI_STEPS):
        found = F.when(ppi <= step, F.lit(float(step))).otherwise(found)
    return F.when(ppi.isNotNull(), F.least(F.greatest(found, F.lit(float(low))), F.lit(float(high))))


def clip_bounds(x0: Column, x1: Column) -> tuple[Column, Column]:
    """Whole pixels of an interval: first and last."""
    return F.floor(F.least(x0, x1)).cast("long"), (F.ceil(F.greatest(x0, x1)) - 1).cast("long")


def span_test(x0: Column, x1: Column, low: Column, high: Column) -> Column:
    """How the span [x0, x1] lies to the clip interval [low, high]."""
    return F.when((x1 < low) | (x0 > high), "AllOutside").when((x0 >= low) & (x1 <= high), "AllInside").otherwise("Partial")


def normalized_rotation(rotate: Column) -> Column:
    """0, 90, 180 or 270; other angles count as none."""
    turn = F.pmod(rotate, F.lit(360))
    return F.when(turn.isin(90, 180, 270), turn).otherwise(0)


def user_unit(unit: Column) -> Column:
    """Within 0.1 to 10; null is 1."""
    return F.least(F.greatest(F.coalesce(unit, F.lit(1.0)), F.lit(0.1)), F.lit(10.0))


def page_geometry(media: Sequence[Column], crop: Sequence[Column], rotate: Column, unit: Column) -> dict[str, Column]:
    """Size as shown, rotation, unit and origin of a page from its boxes."""
    box = box_intersection(normalized_box(*media), normalized_box(*crop))
    turn, scale = normalized_rotation(rotate), user_unit(unit)
    width, height = (box[2] - box[0]) * scale, (box[3] - box[1]) * scale
    lying = turn.isin(90, 270)
    return {"width_pts": F.when(lying, height).otherwise(width), "height_pts": F.when(lying, width).otherwise(height), "rotate_cw": turn, "user_unit": scale, "origin_x": box[0], "origin_y": box[1]}


def initial_matrix(width: Column, height: Column, turn: Column, scale: Column, x: Column, y: Column) -> tuple[Column, ...]:
    """From the page's unrotated space of a box (x, y, width, height) to pixels with y running down."""
    none = F.lit(0.0)
    rows = {0: (scale, none, none, -scale, -x * scale, (y + height) * scale), 90: (none, scale, scale, none, -y * scale, -x * scale), 180: (-scale, none, none, scale, (x + width) * scale, -y * scale), 270: (none, -scale, -scale, none, (y + height) * scale, (x + width) * scale)}
    out = []
    for i in range(6):
        value = rows[0][i]
        for angle in (90, 180, 270):
            value = F.when(turn == angle, rows[angle][i]).otherwise(value)
        out.append(value)
    return tuple(out)


def combined_scale(x_dpi: Column, y_dpi: Column) -> Column:
    """Of both resolutions (150 where there is none)."""
    return F.sqrt(F.coalesce(x_dpi, F.lit(150.0)) / 72 * (F.coalesce(y_dpi, F.lit(150.0)) / 72))
