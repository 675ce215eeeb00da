"""Colour differences and contrast as Column expressions over '#rrggbb'."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Viénot's matrices for linear RGB, the sRGB primaries, and the palette's limits.
VIENOT = {
    "protanopia": ((0.11238, 0.88762, 0.0), (0.11238, 0.88762, 0.0), (0.00401, -0.00401, 1.0)),
    "deuteranopia": ((0.29275, 0.70725, 0.0), (0.29275, 0.70725, 0.0), (-0.02234, 0.02234, 1.0)),
    "tritanopia": ((1.0, 0.14461, -0.14461), (0.0, 1.0, 0.0), (0.0, 0.85924, 0.14076)),
}
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
MIN_DELTA, MIN_TEXT, MIN_BODY = 20.0, 4.5, 7.0


def let(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _struct(names: str, values) -> Column:
    return F.struct(*[v.alias(n) for n, v in zip(names, values, strict=True)])


def _product(matrix, vector: Column) -> list[Column]:
    return [sum((vector[n] * k for n, k in zip("rgb", row, strict=True)), F.lit(0.0)) for row in matrix]


def linear(hex_code: Column) -> Column:
    """struct<r, g, b> in linear light."""
    def one(at: int) -> Column:
        bright = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))
        return let(F.conv(F.substring(hex_code, at, 2), 16, 10).cast("double") / 255, bright)

    return _struct("rgb", [one(k) for k in (2, 4, 6)])


def simulate(rgb: Column, kind: str) -> Column:
    """Linear light as someone with the deficiency sees it, clipped to what a screen shows."""
    return _struct("rgb", [F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for v in _product(VIENOT[kind], rgb)])


def luminance(rgb: Column) -> Column:
    return rgb["r"] * 0.2126 + rgb["g"] * 0.7152 + rgb["b"] * 0.0722


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def lab(rgb: Column) -> Column:
    edge = 6 / 29
    root = lambda t: F.when(t > edge**3, F.pow(t, F.lit(1 / 3))).otherwise(t / (3 * edge**2) + 4 / 29)
    roots = lambda v: _struct("xyz", [let(t / w, root) for t, w in zip(_product(TO_XYZ, v), WHITE, strict=True)])
    return let(let(rgb, roots), lambda f: _struct("lab", [116 * f["y"] - 16, 500 * (f["x"] - f["y"]), 200 * (f["y"] - f["z"])]))


def ciede2000(p: Column, q: Column) -> Column:
    """The CIE's 2000 formula with unit weights, in steps that each bind what they make."""
    cos = lambda d: F.cos(F.radians(d))
    seven = lambda c: F.sqrt(F.pow(c, F.lit(7.0)) / (F.pow(c, F.lit(7.0)) + 25.0**7))
    polar = lambda a, b: F.struct(F.hypot(a, b).alias("c"), F.pmod(F.degrees(F.atan2(b, a)), F.lit(360.0)).alias("h"))

    def stretched(v: Column) -> Column:
        chroma = (F.hypot(v["p"]["a"], v["p"]["b"]) + F.hypot(v["q"]["a"], v["q"]["b"])) / 2
        points = lambda k: F.struct(polar(v["p"]["a"] * k, v["p"]["b"]).alias("p"), polar(v["q"]["a"] * k, v["q"]["b"]).alias("q"), ((v["p"]["l"] + v["q"]["l"]) / 2).alias("l"), (v["q"]["l"] - v["p"]["l"]).alias("d"))
        return let(1.5 - 0.5 * seven(chroma), points)

    def differences(v: Column) -> Column:
        grey, turn, total = v["p"]["c"] * v["q"]["c"] == 0, v["q"]["h"] - v["p"]["h"], v["p"]["h"] + v["q"]["h"]
        arc = F.when(grey, F.lit(0.0)).when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
        hue = F.when(grey, total).when(F.abs(turn) <= 180, total / 2).when(total < 360, total / 2 + 180).otherwise(total / 2 - 180)
        across = 2 * F.sqrt(v["p"]["c"] * v["q"]["c"]) * F.sin(F.radians(arc) / 2)
        return F.struct(v["l"].alias("l"), v["d"].alias("d"), ((v["p"]["c"] + v["q"]["c"]) / 2).alias("c"), (v["q"]["c"] - v["p"]["c"]).alias("e"), across.alias("f"), hue.alias("h"))

    def weighted(v: Column) -> Column:
        t = 1 - 0.17 * cos(v["h"] - 30) + 0.24 * cos(2 * v["h"]) + 0.32 * cos(3 * v["h"] + 6) - 0.20 * cos(4 * v["h"] - 63)
        off = F.pow(v["l"] - 50, F.lit(2.0))
        rotation = -2 * seven(v["c"]) * F.sin(math.pi / 3 * F.exp(-F.pow((v["h"] - 275) / 25, F.lit(2.0))))
        parts = [v["d"] / (1 + 0.015 * off / F.sqrt(20 + off)), v["e"] / (1 + 0.045 * v["c"]), v["f"] / (1 + 0.015 * v["c"] * t), rotation]
        return _struct("lchr", parts)

    steps = let(let(let(F.struct(p.alias("p"), q.alias("q")), stretched), differences), weighted)
    return let(steps, lambda w: F.sqrt(w["l"] * w["l"] + w["c"] * w["c"] + w["h"] * w["h"] + w["r"] * w["c"] * w["h"]))


def distinct_to_all(a: Column, b: Column, least: float = MIN_DELTA) -> Column:
    """Whether two colours (linear light) are at least so far apart for every kind of sight."""
    ok = ciede2000(lab(a), lab(b)) >= least
    for kind in VIENOT:
        ok = ok & (ciede2000(lab(simulate(a, kind)), lab(simulate(b, kind))) >= least)
    return ok


def legible(a: Column, b: Column, least: float = MIN_TEXT) -> Column:
    """Whether text in one colour can be read on the other; MIN_BODY for body text."""
    return contrast(a, b) >= least
