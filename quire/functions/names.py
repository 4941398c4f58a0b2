"""Names of colour spaces, filters and graphics-state values as Column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.color import PIXEL_MODES, long

# The short names of inline images.
INLINE_KEYS = {"BPC": "BitsPerComponent", "CS": "ColorSpace", "D": "Decode", "DP": "DecodeParms", "F": "Filter", "H": "Height", "IM": "ImageMask", "I": "Interpolate", "W": "Width"}
INLINE_SPACES = {"G": "DeviceGray", "RGB": "DeviceRGB", "CMYK": "DeviceCMYK", "I": "Indexed"}
INLINE_FILTERS = {"A85": "ASCII85Decode", "AHx": "ASCIIHexDecode", "CCF": "CCITTFaxDecode", "DCT": "DCTDecode", "Fl": "FlateDecode", "LZW": "LZWDecode", "RL": "RunLengthDecode"}
BLEND_MODES = ["Normal", "Compatible", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion", "Hue", "Saturation", "Color", "Luminosity"]
DEVICE_FAMILY = {"DeviceGray": "DeviceGray", "CalGray": "DeviceGray", "DeviceRGB": "DeviceRGB", "CalRGB": "DeviceRGB", "DeviceCMYK": "DeviceCMYK"}
MAX_HOPS = 32


def looked_up(names: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), key)


def expanded(names: dict[str, str], key: Column) -> Column:
    """The full name of a short one; others as they are."""
    return F.coalesce(looked_up(names, key), key)


def icc_family(components: Column) -> Column:
    """The device space that stands in for a profile of so many components."""
    return F.when(components == 4, "DeviceCMYK").when(components == 3, "DeviceRGB").otherwise("DeviceGray")


def device_family(family: Column) -> Column:
    """Calibrated spaces as device spaces; unknown ones are gray."""
    return F.coalesce(looked_up(DEVICE_FAMILY, family), F.lit("DeviceGray"))


def blend_mode(candidates: Column) -> Column:
    """The first known name of a list, else Normal."""
    known = F.filter(candidates, lambda n: n.isin(*BLEND_MODES))
    return F.regexp_replace(F.coalesce(F.get(known, 0), F.lit("Normal")), "^Compatible$", "Normal")


def tint_family(count: Column) -> Column:
    """Of a pattern's colour operands without a base space."""
    return F.when(count == 1, "DeviceGray").when(count == 3, "DeviceRGB").when(count == 4, "DeviceCMYK")


def terminal_filter(filters: Column) -> Column:
    """The last of a chain, Raw if it is no image codec or there is none."""
    last = F.try_element_at(filters, F.lit(-1))
    return F.coalesce(F.when(last.isin("DCTDecode", "JPXDecode", "CCITTFaxDecode", "JBIG2Decode", "FlateDecode"), last), F.lit("Raw"))


def pixel_mode(mode: Column) -> dict[str, Column]:
    out = {}
    for i, name in enumerate(("components", "bits", "bytes")):
        value = F.lit(None).cast("long")
        for key, row in PIXEL_MODES.items():
            value = F.when(mode == key, long(row[i])).otherwise(value)
        out[name] = value
    return out


def resolved(refs: DataFrame, hops: int = MAX_HOPS) -> DataFrame:
    """(obj, target, hops): where chains of references end; target is null for cycles, missing objects and
    chains of more than ``hops``. ``refs``: (obj, next), next null for objects that are no references.

    By pointer doubling: after k rounds an object knows what is 2^k hops on."""
    at = refs.select("obj", F.coalesce("next", "obj").alias("to"), F.when(F.col("next").isNull(), 0).otherwise(1).alias("n"))
    rounds = max(1, (hops - 1).bit_length())
    for _ in range(rounds):
        on = at.select(F.col("obj").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
        at = at.join(on, "to", "left").select("obj", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n"))
    ends = refs.where("next IS NULL").select(F.col("obj").alias("to"), F.lit(True).alias("_end"))
    return at.join(ends, "to", "left").select("obj", F.when(F.col("_end") & (F.col("n") <= hops), F.col("to")).alias("target"), F.when(F.col("_end") & (F.col("n") <= hops), F.col("n")).alias("hops"))
