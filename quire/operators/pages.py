"""Choosing, numbering and naming pages; resources by key, range and step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_range(pages: DataFrame, total: Column, first: int = 1, last: int | None = None, parity: str | None = None) -> DataFrame:
    """Pages of [first, last], clamped to the document; ``parity`` is odd, even or None."""
    if first < 1 or last is not None and last < first:
        raise ValueError(f"pages {first} to {last}")
    page = F.col("page")
    kept = pages.where(page.between(F.greatest(F.lit(first), F.lit(1)), F.least(F.lit(last), total) if last is not None else total))
    return kept.where(page % 2 == (1 if parity == "odd" else 0)) if parity else kept


def first_page(pages: DataFrame, *keys: str) -> DataFrame:
    """One page of each document: the first."""
    return pages.groupBy(*keys).agg(F.min("page").alias("page"))


def page_set(pages: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    return pages.join(wanted.where("page >= 1").select(*keys, "page").distinct(), [*keys, "page"], "left_semi")


def resolve_pages(wanted: DataFrame, pages: DataFrame, *keys: str) -> DataFrame:
    """Wanted pages with ``error`` PageOutOfRange where the document has none."""
    marked = wanted.join(pages.select(*keys, "page").withColumn("found", F.lit(True)), [*keys, "page"], "left")
    return marked.withColumn("error", F.when(F.col("found").isNull(), "PageOutOfRange")).drop("found")


def output_name(prefix: Column, page: Column, total: Column, extension: Column, separator: str = "-") -> Column:
    """Page numbers are as wide as the last one."""
    digits = F.length(total.cast("string"))
    return F.concat(prefix, F.lit(separator), F.lpad(page.cast("string"), digits, F.lit("0")), F.lit("."), extension)


#: (format, mono, gray) -> extension; None where the format can't hold it.
EXTENSIONS = {("ppm", True): "pbm", ("ppm", False): "ppm", ("png", True): "png", ("png", False): "png"}


def extension(fmt: Column, mono: Column, gray: Column) -> Column:
    return F.when(fmt == "png", "png").when(fmt == "ppm", F.when(mono, "pbm").when(gray, "pgm").otherwise("ppm"))


def latest_wins(sections: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last section's entry of each object, whatever earlier ones say."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return sections.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def dominant(rows: DataFrame, keys: list[str], value: str, ordinal: Column) -> DataFrame:
    """The commonest value of each group; among equals the one of the last ordinal."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.max(ordinal).alias("ordinal"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("n", "ordinal")).alias(value), F.max("n").alias("n"))


def interval_lookup(probes: DataFrame, segments: DataFrame, keys: list[str], at: str, default: Column, step: int = 64) -> DataFrame:
    """Adds ``width`` to probes: of the first segment [first, last] that holds ``at``, else the
    default. Segments are spread over cells of ``step``, so that the join is on equal cells
    and grows with their lengths, not with all pairs."""
    cells = F.sequence(F.expr(f"first div {step}"), F.expr(f"last div {step}"))
    spread = segments.select(*keys, "first", "last", "ord", "w", F.explode(cells).alias("_cell"))
    marked = probes.withColumn("_cell", F.expr(f"`{at}` div {step}")).withColumn("_id", F.struct(*keys, at))
    hits = marked.select(*keys, at, "_cell").distinct().join(spread, [*keys, "_cell"]).where(F.col(at).between(F.col("first"), F.col("last")))
    best = hits.groupBy(*keys, at).agg(F.min_by("w", "ord").alias("_w"))
    return probes.join(best, [*keys, at], "left").withColumn("width", F.coalesce("_w", default)).drop("_w")


def stitch_index(t: Column, bounds: Column) -> Column:
    """Which part of a stitched function t falls in: the number of bounds at or below it."""
    return F.size(F.filter(bounds, lambda b: b <= t))


def subtree_sums(nodes: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Exclusive running sums of leaf counts among the kids of a node."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("before", F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def visible(marks: DataFrame, off: DataFrame, on: DataFrame, key: str) -> DataFrame:
    """Marks whose layer is not hidden: hidden are those switched off and not on again."""
    return marks.join(off.join(on, key, "left_anti"), key, "left_anti")


def digest(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)
