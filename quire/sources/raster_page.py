"""Drawing a page: see :mod:`quire.drawing.page`, whose main names are here."""

from quire.drawing.page import Page, base_matrix, draw, luma, round_half
from quire.drawing.paths import crossings, fill_mask, flatten

__all__ = ["Page", "base_matrix", "crossings", "draw", "fill_mask", "flatten", "luma", "round_half"]
