"""Byte functions over all pairs of bytes, against plain Python."""

import math

from pyspark.sql import functions as F

from quire.functions import blend as B
from quire.functions import color as C


def trunc(a, b):
    return int(a / b) if abs(a) < 1 << 50 else a // b


def d255(x):
    return min((x + (x >> 8) + 128) >> 8, 255)


def overlay(s, d):
    return d255(2 * s * d) if d < 128 else 255 - d255(2 * (255 - s) * (255 - d))


def soft(s, d):
    if s < 128:
        v = d - trunc((255 - 2 * s) * d * (255 - d), 65025)
    else:
        x = trunc((trunc((16 * d - 3060) * d, 255) + 1020) * d, 255) if d < 64 else int(math.sqrt(255 * d))
        v = d + trunc((2 * s - 255) * (x - d), 255)
    return min(max(v, 0), 255)


EXPECTED = {
    "multiply": lambda s, d: d255(s * d),
    "screen": lambda s, d: s + d - d255(s * d),
    "overlay": overlay,
    "hard_light": lambda s, d: overlay(d, s),
    "color_dodge": lambda s, d: 255 if s == 255 else min(255 * d // (255 - s), 255),
    "color_burn": lambda s, d: 0 if s == 0 else max(255 - 255 * (255 - d) // s, 0),
    "soft_light": soft,
    "exclusion": lambda s, d: max(s + d - d255(2 * s * d), 0),
}


def test_blend_modes_over_all_bytes(spark):
    pairs = spark.range(65536).select((F.col("id") % 256).alias("s"), C.div(F.col("id"), 256).alias("d"))
    s, d = F.col("s"), F.col("d")
    rows = pairs.select("s", "d", *[B.SEPARABLE[k](s, d).alias(k) for k in EXPECTED]).collect()
    assert len(rows) == 65536
    for r in rows:
        for k, f in EXPECTED.items():
            assert r[k] == f(r["s"], r["d"]), (k, r)


def test_non_separable_modes_keep_the_luminosity_that_they_take(spark):
    grays = spark.range(256).select(F.col("id").alias("v"))
    v = F.col("v")
    row = grays.select(B.luminosity((v, v, v), (C.long(10), C.long(10), C.long(10))).alias("c"), "v").collect()
    assert all(r["c"]["r"] == r["c"]["g"] == r["c"]["b"] == r["v"] for r in row)
