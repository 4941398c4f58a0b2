"""Content operators as relations: typed operators, operands, paths, paints, clips, layers, text
positions, and the graphics state as an ordered fold over a page's operators.

Rows of ``ops`` have the page's keys, ``seq`` and ``op``; most functions are windows over them. Pages
are bounded, so a window or a fold never holds more than one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The kind of each keyword.
VARIANTS = {
    "q": "Save", "Q": "Restore", "cm": "ConcatMatrix", "w": "SetLineWidth", "J": "SetLineCap", "j": "SetLineJoin", "M": "SetMiterLimit", "d": "SetDash", "ri": "SetRenderingIntent", "i": "SetFlatness", "gs": "SetExtGState",
    "m": "MoveTo", "l": "LineTo", "c": "CurveTo", "v": "CurveToV", "y": "CurveToY", "h": "ClosePath", "re": "Rectangle",
    "S": "Stroke", "s": "CloseStroke", "f": "Fill", "F": "Fill", "f*": "FillEvenOdd", "B": "FillStroke", "B*": "FillStrokeEvenOdd", "b": "CloseFillStroke", "b*": "CloseFillStrokeEvenOdd", "n": "EndPath", "W": "Clip", "W*": "ClipEvenOdd",
    "BT": "BeginText", "ET": "EndText", "Tf": "SetFont", "Tc": "SetCharSpacing", "Tw": "SetWordSpacing", "Tz": "SetHorizScaling", "TL": "SetLeading", "Ts": "SetTextRise", "Tr": "SetTextRenderMode",
    "Td": "TextMove", "TD": "TextMoveSetLeading", "Tm": "SetTextMatrix", "T*": "NextLine", "Tj": "ShowText", "TJ": "ShowTextArray", "'": "MoveNextLineShow", '"': "MoveNextLineShowSpaced",
    "cs": "SetFillColorSpace", "CS": "SetStrokeColorSpace", "sc": "SetFillColor", "SC": "SetStrokeColor", "scn": "SetFillColor", "SCN": "SetStrokeColor",
    "g": "SetFillGray", "G": "SetStrokeGray", "rg": "SetFillRgb", "RG": "SetStrokeRgb", "k": "SetFillCmyk", "K": "SetStrokeCmyk",
    "Do": "PaintXObject", "BI": "InlineImage", "sh": "PaintShading", "d0": "Type3GlyphWidth", "d1": "Type3GlyphWidthBBox",
    "BMC": "MarkedContent", "BDC": "MarkedContent", "MP": "MarkedContent", "DP": "MarkedContent", "EMC": "EndOptionalContent", "BX": "CompatibilitySection", "EX": "CompatibilitySection",
}
#: Painting operators: (closes the path, fill rule or None, strokes).
PAINTS = {"f": (False, "nz", False), "F": (False, "nz", False), "f*": (False, "eo", False), "S": (False, None, True), "s": (True, None, True), "B": (False, "nz", True), "B*": (False, "eo", True), "b": (True, "nz", True), "b*": (True, "eo", True), "n": (False, None, False)}
#: Components of the device colour operators.
COLORS = {"g": 1, "G": 1, "rg": 3, "RG": 3, "k": 4, "K": 4}
MAX_UNKNOWN = 256


def variant(op: Column, name: Column | None = None) -> Column:
    """The kind of an operator; patterns and layers are told by their name operand."""
    known = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in VARIANTS.items() for x in pair]), op), F.lit("Unknown"))
    if name is None:
        return known
    return F.when((op == "scn") & name.isNotNull(), "SetFillPattern").when((op == "SCN") & name.isNotNull(), "SetStrokePattern").when((op == "BDC") & (name == "OC"), "BeginOptionalContent").otherwise(known)


def page_window(keys: list[str], order: str = "seq") -> Window:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def clamped_depth(ops: DataFrame, keys: list[str], step: Column, order: str = "seq") -> DataFrame:
    """Adds ``depth``: the running sum of steps, where a step below zero does nothing."""
    w = page_window(keys, order)
    summed = ops.withColumn("_sum", F.sum(step).over(w))
    return summed.withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.min("_sum").over(w))).drop("_sum")


def grouped_operands(tokens: DataFrame, keys: list[str], is_op: Column, order: str = "seq") -> DataFrame:
    """(keys, seq, op, operands): tokens before an operator are its operands; stray ones at the
    end of a page are dropped. ``tokens`` has seq, token."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    marked = tokens.withColumn("_op", is_op).withColumn("_group", F.coalesce(F.sum(F.col("_op").cast("int")).over(before), F.lit(0)))
    grouped = marked.groupBy(*keys, "_group").agg(
        F.max(F.when(F.col("_op"), F.col(order))).alias(order),
        F.max(F.when(F.col("_op"), F.col("token"))).alias("op"),
        F.array_sort(F.collect_list(F.when(~F.col("_op"), F.struct(order, "token")))).alias("_operands"),
    )
    return grouped.where("op IS NOT NULL").select(*keys, order, "op", F.transform("_operands", lambda x: x["token"]).alias("operands"))


def path_points(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, k, x, y, curve): points of path operators with ``nums``, with the current point as
    the first control of v, the end as the second control of y, and h and re closing."""
    w, before = page_window(keys), Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    n = lambda i: F.get("nums", i)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    op = F.col("op")
    start = F.last(F.when(op.isin("m", "re"), point(n(0), n(1))), ignorenulls=True).over(w)
    placed = ops.withColumn("_start", start)
    end = F.when(op.isin("m", "l", "re"), point(n(0), n(1))).when(op == "c", point(n(4), n(5))).when(op.isin("v", "y"), point(n(2), n(3))).when(op == "h", F.col("_start"))
    # What comes before a subpath is begun draws nothing.
    placed = placed.where("_start IS NOT NULL").withColumn("_end", end).withColumn("_here", F.last("_end", ignorenulls=True).over(before))
    a, b = point(n(0), n(1)), point(n(2), n(3))
    corners = F.array(point(n(0), n(1)), point(n(0) + n(2), n(1)), point(n(0) + n(2), n(1) + n(3)), point(n(0), n(1) + n(3)), point(n(0), n(1)))
    points = (
        F.when(op.isin("m", "l"), F.array(a))
        .when(op == "c", F.array(a, b, point(n(4), n(5))))
        .when(op == "v", F.array(F.col("_here"), a, b))
        .when(op == "y", F.array(a, b, b))
        .when(op == "h", F.array(F.col("_start")))
        .when(op == "re", corners)
    )
    usable = placed.where(op.isin("m", "re") | op.isin("l", "c", "v", "y", "h") & F.col("_here").isNotNull())
    return usable.select(*keys, "seq", op.isin("c", "v", "y").alias("curve"), F.posexplode(points).alias("k", "p")).select(*keys, "seq", "k", "p.x", "p.y", "curve")


def paints(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, kind, rule, closes): one row for each paint; operators that fill and stroke give two,
    and n gives none."""
    rows = F.lit(None).cast("array<struct<kind:string,rule:string,closes:boolean>>")
    for op, (closes, rule, strokes) in PAINTS.items():
        own = [F.struct(F.lit(kind).alias("kind"), F.lit(r).cast("string").alias("rule"), F.lit(closes).alias("closes")) for kind, r in ([("fill", rule)] if rule else []) + ([("stroke", None)] if strokes else [])]
        if own:
            rows = F.when(F.col("op") == op, F.array(*own)).otherwise(rows)
    return ops.select(*keys, "seq", F.inline(rows))


def clips(ops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, rule): painting operators at which a pending clip takes effect; the last W or W*
    since the painting operator before counts."""
    before = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    paint = F.col("op").isin(*PAINTS)
    grouped = ops.withColumn("_path", F.coalesce(F.sum(paint.cast("int")).over(before), F.lit(0)))
    rule = F.max_by(F.when(F.col("op") == "W", "nz").otherwise("eo"), F.when(F.col("op").isin("W", "W*"), F.col("seq")))
    marked = grouped.groupBy(*keys, "_path").agg(F.max(F.when(paint, F.col("seq"))).alias("seq"), F.when(F.max(F.col("op").isin("W", "W*").cast("int")) == 1, rule).alias("rule"))
    return marked.where("seq IS NOT NULL AND rule IS NOT NULL").select(*keys, "seq", "rule")


def device_color(op: Column, nums: Column) -> Column:
    """r, g and b bytes of a device colour operator with its 0..1 operands, or null."""
    from quire.functions.color import cmyk_reflectance, unit_to_byte

    v = [unit_to_byte(F.get(nums, i)) for i in range(4)]
    rgb = lambda c: F.struct(*[x.alias(n) for x, n in zip(c, "rgb")])
    return F.when(F.lower(op) == "g", rgb([v[0]] * 3)).when(F.lower(op) == "rg", rgb(v[:3])).when(F.lower(op) == "k", rgb(cmyk_reflectance(*v)))


def hidden(ops: DataFrame, keys: list[str], opens: Column, closes: Column, off: Column) -> DataFrame:
    """Adds ``hidden``: whether an enclosing marked content is switched off.

    Openings and closings of one level follow each other, so an opening's end is the next row of
    its level; what stands in between is counted by a running sum."""
    step = F.when(opens, 1).when(closes, -1).otherwise(0)
    deep = clamped_depth(ops.withColumn("_step", step), keys, F.col("_step"))
    level = F.when(opens, F.col("depth")).when(closes, F.col("depth") + 1)
    along = Window.partitionBy(*keys, "_level").orderBy("seq")
    leveled = deep.withColumn("_level", level).withColumn("_mark", F.when(opens & off, 1).when(closes & F.lag(opens & off).over(along), -1).otherwise(0))
    counted = leveled.withColumn("_off", F.sum("_mark").over(page_window(keys)))
    return counted.withColumn("hidden", F.col("_off") > 0).drop("_step", "depth", "_level", "_mark", "_off")


def text_lines(ops: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``tx`` and ``ty``, the start of the line after each text operator, where text matrices only
    move: sums of moves since the last BT or Tm, with the leading carried forward."""
    w = page_window(keys)
    op, n = F.col("op"), lambda i: F.get("nums", i)
    # TD sets the leading that T* uses, and so do TL, ' and ".
    leading = F.last(F.when(op == "TL", n(0)).when(op == "TD", -n(1)), ignorenulls=True).over(w)
    reset = F.sum(op.isin("BT", "Tm").cast("int")).over(w)
    led = ops.withColumn("_leading", F.coalesce(leading, F.lit(0))).withColumn("_object", reset)
    dx = F.when(op.isin("Td", "TD"), n(0)).when(op == "Tm", n(4)).otherwise(0)
    dy = F.when(op.isin("Td", "TD"), n(1)).when(op == "Tm", n(5)).when(op.isin("T*", "'", '"'), -F.col("_leading")).otherwise(0)
    line = Window.partitionBy(*keys, "_object").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return led.withColumn("tx", F.sum(dx).over(line)).withColumn("ty", F.sum(dy).over(line)).drop("_leading", "_object")


def unknown_report(ops: DataFrame, keys: list[str], known: Column, most: int = MAX_UNKNOWN) -> DataFrame:
    """(keys, op, rank): each unknown keyword of a page once, in the order of its first use, ``most`` at most."""
    first = ops.where(~known).groupBy(*keys, "op").agg(F.min("seq").alias("seq"))
    w = Window.partitionBy(*keys).orderBy("seq")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("seq")


def form_expansion(uses: DataFrame, roots: DataFrame, depth: int = 32) -> DataFrame:
    """(root, form, path): forms drawn by each root, with the order of drawing as ``path`` (a dotted
    list of places). ``uses``: (form, ord, child). A form within itself is not drawn again."""
    level = roots.select(F.col("form").alias("root"), "form", F.array().cast("array<int>").alias("path"), F.array("form").alias("above"))
    out = level
    for _ in range(depth):  # a bounded number of joins; empty levels end early at run time
        level = level.join(uses, "form").where(~F.array_contains("above", F.col("child")))
        level = level.select("root", F.col("child").alias("form"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path"), F.concat("above", F.array("child")).alias("above"))
        out = out.unionByName(level)
    return out.select("root", "form", F.array_join(F.transform("path", lambda p: p.cast("string")), ".").alias("path"))


# The graphics state: a fold over each page's operators, in Arrow batches.

Step = Callable[[dict, str, list], dict]


def fold_pages(ops: DataFrame, keys: list[str], start: dict, step: Callable, emits: set[str], schema: str) -> DataFrame:
    """For each operator in ``emits`` the state at that point: (keys, seq, op, the state's fields in
    ``schema``). ``step(state, op, nums)`` changes the state in place; q and Q save and restore it. Pages
    are dealt by their keys and streamed in order; only the state of one is held."""
    spark = ops.sparkSession
    fields = [f.split()[0] for f in schema.split(", ")]
    kinds = ", ".join(f"`{k}` {ops.schema[k].dataType.simpleString()}" for k in keys)
    out_schema = f"{kinds}, seq long, op string, {schema}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import copy

        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(parsed)
        page, state, stack = None, copy.deepcopy(start), []
        for batch in batches:
            out = []
            columns = [batch.column(k).to_pylist() for k in (*keys, "seq", "op", "nums")]
            for *own, seq, op, nums in zip(*columns):
                if own != page:
                    page, state, stack = own, copy.deepcopy(start), []
                if op == "q":
                    stack.append(copy.deepcopy(state))
                elif op == "Q":
                    state = stack.pop() if stack else state
                else:
                    step(state, op, nums or [])
                if op in emits:
                    out.append((*own, seq, op, *(state[f] for f in fields)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), types)], [t.name for t in types])

    parsed = spark.createDataFrame([], out_schema).schema
    read = ops.select(*keys, F.col("seq").cast("long").alias("seq"), "op", F.col("nums").cast("array<double>").alias("nums"))
    return read.repartition(*keys).sortWithinPartitions(*keys, "seq").mapInArrow(run, out_schema)


GRAPHICS_STATE = {"ctm": [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], "line_width": 1.0, "line_cap": 0.0, "line_join": 0.0, "miter_limit": 10.0, "flatness": 0.1, "fill": [0.0], "stroke": [0.0], "char_space": 0.0, "word_space": 0.0, "horiz_scale": 1.0, "leading": 0.0, "rise": 0.0, "font_size": 0.0, "render_mode": 0.0}
GRAPHICS_SCHEMA = "ctm array<double>, line_width double, line_cap double, line_join double, miter_limit double, flatness double, fill array<double>, stroke array<double>, char_space double, word_space double, horiz_scale double, leading double, rise double, font_size double, render_mode double"
SCALARS = {"w": "line_width", "J": "line_cap", "j": "line_join", "M": "miter_limit", "Tc": "char_space", "Tw": "word_space", "TL": "leading", "Ts": "rise", "Tr": "render_mode", "Tf": "font_size"}


def graphics_step(state: dict, op: str, nums: list) -> None:
    """One operator's effect; operators with too few operands have none."""
    from quire.drawing.page import product

    if op == "cm" and len(nums) >= 6:
        state["ctm"] = list(product(nums[:6], state["ctm"]))
    elif op in SCALARS and nums:
        state[SCALARS[op]] = nums[0]
    elif op == "i" and nums:
        state["flatness"] = max(nums[0], 0.1)
    elif op == "Tz" and nums:
        state["horiz_scale"] = nums[0] / 100
    elif op in ("g", "rg", "k", "sc", "scn") and nums:
        state["fill"] = nums
    elif op in ("G", "RG", "K", "SC", "SCN") and nums:
        state["stroke"] = nums


def graphics_states(ops: DataFrame, keys: list[str], emits: set[str] | None = None) -> DataFrame:
    """The graphics state at every painting and text-showing operator (or those given)."""
    return fold_pages(ops, keys, GRAPHICS_STATE, graphics_step, emits or {*PAINTS, "Tj", "TJ", "'", '"', "Do", "BI", "sh"}, GRAPHICS_SCHEMA)
