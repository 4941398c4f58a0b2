"""Queries of the colour, blending and lookup operators over pixels made of lineitem's keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import blend as B
from quire.functions import color as C
from quire.plans.registry import query, table

PX = "WITH px AS (SELECT DISTINCT l_orderkey % 256 AS s, (l_partkey * 7) % 256 AS d, (l_suppkey * 13) % 256 AS a FROM lineitem) "
#: div255 in SQL.
D255 = "least((({x}) + (({x}) >> 8) + 128) >> 8, 255)"


def d255(x: str) -> str:
    return D255.format(x=x)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select((F.col("l_orderkey") % 256).alias("s"), (F.col("l_partkey") * 7 % 256).alias("d"), (F.col("l_suppkey") * 13 % 256).alias("a")).distinct()


def expression(name: str, sql: str, make) -> None:
    """A query of s, d, a and the columns that ``make(s, d, a)`` names."""

    @query(name, PX + f"SELECT s, d, a, {sql} FROM px")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, d, a = (F.col(x) for x in "sda")
        made: dict[str, Column] = make(s, d, a)
        return pixels(spark, sf_dir).select("s", "d", "a", *[v.alias(k) for k, v in made.items()])


expression("div255", f"{d255('s * d')} AS v", lambda s, d, a: {"v": C.div255(s * d)})
expression("lerp_u8", f"{d255('s * (256 - a) + d * a')} AS v", lambda s, d, a: {"v": C.lerp(s, d, a)})
expression(
    "cmyk_saturating",
    "greatest(255 - s - a, 0) AS r, greatest(255 - d - a, 0) AS g, greatest(255 - (s + d) % 256 - a, 0) AS b",
    lambda s, d, a: dict(zip("rgb", C.cmyk_saturating(s, d, (s + d) % 256, a))),
)
expression(
    "cmyk_reflectance",
    "((255 - s) * (255 - a) + 127) // 255 AS r, ((255 - d) * (255 - a) + 127) // 255 AS g, ((255 - (s + d) % 256) * (255 - a) + 127) // 255 AS b",
    lambda s, d, a: dict(zip("rgb", C.cmyk_reflectance(s, d, (s + d) % 256, a))),
)
expression("luma_bt709", "(2126 * s + 7152 * d + 722 * a + 5000) // 10000 AS v", lambda s, d, a: {"v": C.luma_output(s, d, a)})
expression("luma_blend", "(77 * s + 151 * d + 28 * a + 128) >> 8 AS v", lambda s, d, a: {"v": C.luma_blend(s, d, a)})
expression(
    "unit_to_byte",
    "CAST(floor(least(greatest((s - 20) / 200.0::DOUBLE, 0.0), 1.0) * 255 + 0.5) AS BIGINT) AS v",
    lambda s, d, a: {"v": C.unit_to_byte((s - 20) / F.lit(200.0))},
)
expression(
    "round_floor_ceil",
    "CAST(floor((s - d) / 8.0::DOUBLE) AS BIGINT) AS down, CAST(ceil((s - d) / 8.0::DOUBLE) AS BIGINT) AS up, CAST(floor((s - d) / 8.0::DOUBLE + 0.5) AS BIGINT) AS near",
    lambda s, d, a: {"down": C.floor_int((s - d) / F.lit(8.0)), "up": C.ceil_int((s - d) / F.lit(8.0)), "near": C.round_int((s - d) / F.lit(8.0))},
)
expression("mono_threshold", "CASE WHEN (2126 * s + 7152 * d + 722 * a + 5000) // 10000 < 128 THEN CAST(255 AS BIGINT) ELSE 0 END AS ink", lambda s, d, a: {"ink": C.mono(C.luma_output(s, d, a))})
expression("transfer_lut", "255 - s AS inverted, s AS restored", lambda s, d, a: {"inverted": C.apply_table(C.inverted_table(), s), "restored": C.apply_table(C.compose_tables(C.inverted_table(), C.inverted_table()), s)})
expression("invert_complement_lut", "255 - ((255 - s) * (255 - s)) // 255 AS v", lambda s, d, a: {"v": C.apply_table(C.invert_complement(F.transform(C.identity_table(), lambda v: F.call_function("div", v * v, F.lit(255)).cast("int"))), s)})
expression(
    "lab_to_srgb",
    ", ".join(
        f"CAST(floor(255 * (CASE WHEN v{k} <= 0.0031308 THEN 12.92 * v{k} ELSE 1.055 * pow(v{k}, 1 / 2.4::DOUBLE) - 0.055 END) + 0.5) AS BIGINT) AS {k}" for k in "rgb"
    ),
    lambda s, d, a: dict(zip("rgb", C.lab_to_srgb(s * F.lit(100.0) / 255, d - F.lit(128.0), a - F.lit(128.0)))),
)
_LAB = """WITH px AS (SELECT DISTINCT l_orderkey % 256 AS s, (l_partkey * 7) % 256 AS d, (l_suppkey * 13) % 256 AS a FROM lineitem),
f AS (SELECT *, (s * 100.0::DOUBLE / 255 + 16) / 116 AS fy, (s * 100.0::DOUBLE / 255 + 16) / 116 + (d - 128.0::DOUBLE) / 500 AS fx, (s * 100.0::DOUBLE / 255 + 16) / 116 - (a - 128.0::DOUBLE) / 200 AS fz FROM px),
xyz AS (SELECT *, """ + ", ".join(f"{w} * CASE WHEN {t} > 6.0::DOUBLE / 29 THEN {t} * {t} * {t} ELSE ({t} - 4.0::DOUBLE / 29) * 3 * (6.0::DOUBLE / 29) * (6.0::DOUBLE / 29) END AS {n}" for n, t, w in (("x", "fx", "0.95047::DOUBLE"), ("y", "fy", "1.0::DOUBLE"), ("z", "fz", "1.08883::DOUBLE"))) + """ FROM f),
lin AS (SELECT *, least(greatest(3.2406 * x - 1.5372 * y - 0.4986 * z, 0), 1) AS vr, least(greatest(-0.9689 * x + 1.8758 * y + 0.0415 * z, 0), 1) AS vg, least(greatest(0.0557 * x - 0.204 * y + 1.057 * z, 0), 1) AS vb FROM xyz)
"""


def _lab_oracle() -> None:
    from quire.plans.registry import ORACLES

    ORACLES["lab_to_srgb"] = _LAB + ORACLES["lab_to_srgb"].removeprefix(PX).replace("FROM px", "FROM lin")


_lab_oracle()

OVERLAY = "CASE WHEN {d} < 128 THEN " + d255("2 * {s} * {d}") + " ELSE 255 - " + d255("2 * (255 - {s}) * (255 - {d})") + " END"
MODES = {
    "normal": "s",
    "multiply": d255("s * d"),
    "screen": "s + d - " + d255("s * d"),
    "overlay": OVERLAY.format(s="s", d="d"),
    "darken": "least(s, d)",
    "lighten": "greatest(s, d)",
    "color_dodge": "CASE WHEN s = 255 THEN 255 ELSE least(255 * d // greatest(255 - s, 1), 255) END",
    "color_burn": "CASE WHEN s = 0 THEN 0 ELSE greatest(255 - 255 * (255 - d) // greatest(s, 1), 0) END",
    "hard_light": OVERLAY.format(s="d", d="s"),
    "soft_light": """least(greatest(CASE WHEN s < 128 THEN d - ((255 - 2 * s) * d * (255 - d)) // 65025
        ELSE d + CAST(trunc((2 * s - 255) * ((CASE WHEN d < 64 THEN CAST(trunc((CAST(trunc((16 * d - 3060) * d / 255.0::DOUBLE) AS BIGINT) + 1020) * d / 255.0::DOUBLE) AS BIGINT)
        ELSE CAST(floor(sqrt((255 * d)::DOUBLE)) AS BIGINT) END) - d) / 255.0::DOUBLE) AS BIGINT) END, 0), 255)""",
    "difference": "abs(s - d)",
    "exclusion": "greatest(s + d - " + d255("2 * s * d") + ", 0)",
}
for _name, _sql in MODES.items():
    expression(f"blend_{_name}", f"CAST({_sql} AS BIGINT) AS v", lambda s, d, a, f=B.SEPARABLE[_name]: {"v": f(s, d)})

# Non-separable modes: the source is (s, d, a), the destination (a, s, d).
LUM = "CAST(floor((77 * {0} + 151 * {1} + 28 * {2} + 128) / 256.0::DOUBLE) AS BIGINT)"
_SRC, _DST = ("s", "d", "a"), ("a", "s", "d")


def _sat(c: tuple[str, str, str]) -> str:
    return f"(greatest({', '.join(c)}) - least({', '.join(c)}))"


def _set_sat(c: tuple[str, str, str], sat: str) -> list[str]:
    low, high = f"least({', '.join(c)})", f"greatest({', '.join(c)})"
    return [f"CASE WHEN {high} > {low} THEN (({x} - {low}) * {sat}) // greatest({high} - {low}, 1) ELSE 0 END" for x in c]


def _non_separable(base: list[str], target: str) -> str:
    """Sets the luminosity of base to target, clips, in steps."""
    pick = ", ".join(f"{x} AS b{i}" for i, x in enumerate(base))
    lum = LUM.format("b0", "b1", "b2")
    clipped = ", ".join(
        f"CAST(CASE WHEN low < 0 THEN least(greatest(lum + CAST(trunc(((c{i} - lum) * lum) / greatest(lum - low, 1)::DOUBLE) AS BIGINT), 0), 255)"
        f" WHEN high > 255 THEN least(greatest(lum + CAST(trunc(((c{i} - lum) * (255 - lum)) / greatest(high - lum, 1)::DOUBLE) AS BIGINT), 0), 255) ELSE c{i} END AS BIGINT) AS {'rgb'[i]}"
        for i in range(3)
    )
    return (
        PX + f", base AS (SELECT s, d, a, {pick}, {target} AS target FROM px),"
        f" moved AS (SELECT *, b0 + target - {lum} AS c0, b1 + target - {lum} AS c1, b2 + target - {lum} AS c2 FROM base),"
        f" ranged AS (SELECT *, least(c0, c1, c2) AS low, greatest(c0, c1, c2) AS high, {LUM.format('c0', 'c1', 'c2')} AS lum FROM moved)"
        f" SELECT s, d, a, {clipped} FROM ranged"
    )


_NON = {
    "hue": _non_separable(_set_sat(_SRC, _sat(_DST)), LUM.format(*_DST)),
    "saturation": _non_separable(_set_sat(_DST, _sat(_SRC)), LUM.format(*_DST)),
    "color": _non_separable(list(_SRC), LUM.format(*_DST)),
    "luminosity": _non_separable(list(_DST), LUM.format(*_SRC)),
}
for _name, _sql in _NON.items():

    @query(f"blend_{_name}", _sql)
    def _run(spark: SparkSession, sf_dir: str, f=B.NON_SEPARABLE[_name]) -> DataFrame:
        s, d, a = (F.col(x) for x in "sda")
        return pixels(spark, sf_dir).select("s", "d", "a", f((s, d, a), (a, s, d)).alias("c")).select("s", "d", "a", "c.*")


expression("porter_duff_div255", f"{d255('(255 - a) * d + a * s')} AS v", lambda s, d, a: {"v": B.over_rounded(s, d, a)})
expression("porter_duff_trunc", "(s * a + d * (255 - a)) // 255 AS v", lambda s, d, a: {"v": B.over_truncated(s, d, a)})
expression(
    "porter_duff_bias",
    "CAST(CASE WHEN a + (s * (255 - a) + 127) // 255 = 0 THEN 0 ELSE least((s * a + d * ((s * (255 - a) + 127) // 255) + (a + (s * (255 - a) + 127) // 255) // 2) // greatest(a + (s * (255 - a) + 127) // 255, 1), 255) END AS BIGINT) AS v, a + (s * (255 - a) + 127) // 255 AS alpha",
    lambda s, d, a: dict(zip(("v", "alpha"), B.over_rgba(s, a, d, s))),
)
expression("soft_mask_multiply", "(s * a + 127) // 255 AS v", lambda s, d, a: {"v": B.soft_mask(s, a)})
expression(
    "overprint_channels",
    "CASE WHEN a & 1 <> 0 THEN CASE WHEN d > 127 THEN least(s + d, 255) ELSE s END ELSE d END AS cyan, CASE WHEN a & 2 <> 0 THEN CASE WHEN d > 127 THEN least(s + d, 255) ELSE s END ELSE d END AS magenta",
    lambda s, d, a: {"cyan": B.overprint(s, d, 0, a, d > 127), "magenta": B.overprint(s, d, 1, a, d > 127)},
)
_A = "least(a + s - " + d255("a * s") + ", 255)"
expression(
    "group_composite",
    f"{_A} AS alpha, CAST(CASE WHEN {_A} = 0 THEN 0 ELSE (({_A} - a) * d + a * s) // greatest({_A}, 1) END AS BIGINT) AS plain,"
    f" CAST(CASE WHEN {_A} = 0 THEN 0 ELSE (({_A} - a) * d + (a * ((255 - s) * s + s * {d255('s * d')})) // 255) // greatest({_A}, 1) END AS BIGINT) AS multiplied",
    lambda s, d, a: (lambda al: {"alpha": al[0], "plain": B.group_color(s, d, None, a, al), "multiplied": B.group_color(s, d, B.multiply(s, d), a, al)})(B.group_alphas(a, s, C.long(255), False)),
)
expression("shape_alpha", f"{d255(d255('s * d') + ' * a')} AS v", lambda s, d, a: {"v": B.shape_alpha(s, a, d)})
