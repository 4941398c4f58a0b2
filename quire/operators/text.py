"""Text as relations: codes to glyphs through chained lookups, widths, pens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CODES = 65_536


def expanded_ranges(ranges: DataFrame, *carry: str) -> DataFrame:
    """(carry, code, cid) of ranges (lo, hi, first); ranges of 65,536 codes and more, or that end before
    they begin, map nothing."""
    usable = ranges.where((F.col("hi") >= F.col("lo")) & (F.col("hi") - F.col("lo") + 1 < MOST_CODES))
    return usable.select(*carry, F.explode(F.sequence("lo", "hi")).alias("code"), "lo", "first").select(*carry, "code", (F.col("first") + F.col("code") - F.col("lo")).alias("cid"))


def glyph_ids(codes: DataFrame, to_cid: DataFrame, to_gid: DataFrame | None) -> DataFrame:
    """Adds cid and gid: code -> CID (0 where the map has none) -> glyph (the CID itself without a map)."""
    with_cid = codes.join(to_cid, "code", "left").withColumn("cid", F.coalesce("cid", F.lit(0)))
    if to_gid is None:
        return with_cid.withColumn("gid", F.col("cid"))
    return with_cid.join(to_gid, "cid", "left").withColumn("gid", F.coalesce("gid", F.lit(0)))


def code_width(code: Column, first: Column, widths: Column, missing: Column) -> Column:
    """From a Widths array that begins at code ``first``; outside it the missing width, and null
    where there is no array at all."""
    at = (code - first).cast("int")
    return F.when(widths.isNotNull(), F.coalesce(F.when(at >= 0, F.get(widths, at)), missing))


def encoded_names(codes: DataFrame, base: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds ``name``: of the differences (font, code, name), else of the base encoding (code, base_name)."""
    return codes.join(changes, ["font", "code"], "left").join(base, "code", "left").withColumn("name", F.coalesce("name", "base_name")).drop("base_name")


def shown_codes(strings: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, k, code): the bytes of shown strings, in order."""
    raw = F.col(text).cast("binary")
    places = F.sequence(F.lit(1), F.length(raw))
    return strings.where(F.length(raw) > 0).select(*keys, F.posexplode(F.transform(places, lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long"))).alias("k", "code"))


def pens(codes: DataFrame, keys: list[str], order: str, size: Column, char_space: Column, word_space: Column, scale: Column) -> DataFrame:
    """Adds ``pen``: where each glyph starts, by the advances before it."""
    advance = (F.col("width") * size + char_space * 1000 + F.when(F.col("code") == 32, word_space * 1000).otherwise(0)) * scale
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return codes.withColumn("pen", F.coalesce(F.sum(advance).over(before), F.lit(0)))


def appearance_streams(annotations: DataFrame, appearances: DataFrame) -> DataFrame:
    """The normal appearance of each annotation (doc, annot, state): the stream of its state, or the only
    one there is (state null). ``appearances``: (doc, annot, state, stream)."""
    own = appearances.withColumnRenamed("state", "for_state")
    on = (annotations["doc"] == own["doc"]) & (annotations["annot"] == own["annot"]) & (own["for_state"].isNull() | (own["for_state"] == annotations["state"]))
    joined = annotations.join(own, on, "left").select(annotations["doc"], annotations["annot"], annotations["state"], "stream", "for_state")
    return joined.groupBy("doc", "annot", "state").agg(F.max_by("stream", F.when(F.col("stream").isNotNull(), F.col("for_state").isNotNull().cast("int"))).alias("stream"))


def inherited_resources(uses: DataFrame, own: DataFrame, above: DataFrame) -> DataFrame:
    """Adds ``res``: the form's own resource of that name, else that of what contains it."""
    mine, theirs = own.withColumnRenamed("res", "_own"), above.withColumnRenamed("res", "_above")
    return uses.join(mine, ["form", "name"], "left").join(theirs, ["parent", "name"], "left").withColumn("res", F.coalesce("_own", "_above")).drop("_own", "_above")
