"""Distances, offsets and projections as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
EARTH_KM = 6371.0
BOUNDS = {"lat": (29.4, 33.4), "lng": (34.2, 35.9)}
TOWN_BOUNDS = {"lat": (29.4, 33.45), "lng": (34.2, 35.95)}
SPREAD_M = 400.0
METRES_PER_DEGREE = 111_320.0
#: Canvas of the country's outline and the box that it shows.
OUTLINE = {"width": 294.62534, "height": 792.60406, "lng_lo": 34.228663, "lat_hi": 33.434207, "lng_hi": 35.935383, "lat_lo": 29.496766}
#: WGS 84.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
#: The least metres of a degree of latitude.
DEGREE_M = 110_574.0


def num(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def haversine_km(lat1, lng1, lat2, lng2) -> Column:
    a, b, c, d = (F.radians(num(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(h > 1.0, 1.0).otherwise(h)))  # null if a point is


def geodesic_m(lat1, lng1, lat2, lng2) -> Column:
    """Metres on the spheroid to first order in its flattening (Andoyer and Lambert); 0 for equal points."""
    a, b, c, d = (F.radians(num(x)) for x in (lat1, lng1, lat2, lng2))
    f, g, l = (a + c) / 2, (a - c) / 2, (b - d) / 2
    s = F.pow(F.sin(g) * F.cos(l), 2) + F.pow(F.cos(f) * F.sin(l), 2)
    k = F.pow(F.cos(g) * F.cos(l), 2) + F.pow(F.sin(f) * F.sin(l), 2)
    w = F.atan(F.sqrt(s / k))
    r = F.sqrt(s * k) / w
    h1, h2 = (3 * r - 1) / (2 * k), (3 * r + 1) / (2 * s)
    metres = 2 * w * AXIS * (1 + FLATTENING * (h1 * F.pow(F.sin(f) * F.cos(g), 2) - h2 * F.pow(F.cos(f) * F.sin(g), 2)))
    return F.when(s <= 1e-20, F.lit(0.0)).otherwise(metres)


def in_bounds(lat: Column, lng: Column, bounds: dict = BOUNDS) -> Column:
    return lat.between(*bounds["lat"]) & lng.between(*bounds["lng"])


def near_box(lat: Column, lng: Column, at_lat: float, at_lng: float, radius_m: float) -> Column:
    """A box that holds the circle: plain comparisons of columns, which reach the scan."""
    d_lat = radius_m / DEGREE_M
    widest = min(89.9, abs(at_lat) + d_lat)
    d_lng = d_lat / math.cos(math.radians(widest))
    return lat.between(at_lat - d_lat, at_lat + d_lat) & lng.between(at_lng - d_lng, at_lng + d_lng)


def disc_offset(key: Column, lat: Column, lng: Column) -> Column:
    """A stable place on the disc round a town's centre, from a hash of the id; struct<lat, lng>."""
    digest = F.sha2(key.cast("string"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("double") / 0xFFFFFFFF
    angle, radius = part(1) * 2 * math.pi, F.sqrt(part(9)) * SPREAD_M
    return F.struct(
        F.round(lat + radius * F.cos(angle) / METRES_PER_DEGREE, 6).alias("lat"),
        F.round(lng + radius * F.sin(angle) / (METRES_PER_DEGREE * F.cos(F.radians(lat))), 6).alias("lng"),
    )


def project(lat: Column, lng: Column) -> Column:
    """struct<x, y, inside> on the outline's canvas."""
    o = OUTLINE
    x = (lng - o["lng_lo"]) / (o["lng_hi"] - o["lng_lo"]) * o["width"]
    y = (o["lat_hi"] - lat) / (o["lat_hi"] - o["lat_lo"]) * o["height"]
    return F.struct(x.alias("x"), y.alias("y"), (x.between(0.0, o["width"]) & y.between(0.0, o["height"])).alias("inside"))


def wave_delay(y: Column) -> Column:
    return (OUTLINE["height"] - y) / OUTLINE["height"] * 1.9


def distance_label(metres: Column) -> Column:
    """A distance as one says it: tens of metres below 950, a decimal of a kilometre below 9500, whole ones beyond.

    Kilometres are rounded as C's printf does: the binary value, ties to the even digit (format_string rounds the shortest decimal, ties up).
    """
    tens = (F.floor(metres / 10 + 0.5) * 10).cast("long").cast("string")
    km = (metres / 1000).cast("double")
    far = F.when(metres < 9500, F.call_function("format_number", km, F.lit("0.0"))).otherwise(F.call_function("format_number", km, F.lit("0")))
    return F.when(metres < 950, F.concat(tens, F.lit(" מ׳"))).when(metres.isNotNull(), F.concat(far, F.lit(" ק״מ")))


def cubes(lat: Column, lng: Column, size_m: float) -> tuple[Column, Column, Column]:
    """Cell of a point in a grid of cubes round the spheroid's centre: points within size_m on the ground are in the same or in neighbouring cubes."""
    phi, e2 = F.radians(lat), FLATTENING * (2 - FLATTENING)
    n = AXIS / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    at = (n * F.cos(phi) * F.cos(F.radians(lng)), n * F.cos(phi) * F.sin(F.radians(lng)), n * (1 - e2) * F.sin(phi))
    side = 1.01 * size_m  # the first-order distance may be short by a little
    return tuple(F.floor(v / side) for v in at)


def map_cell(lat: Column, lng: Column, zoom: int, radius_px: int = 46, tile_px: int = 512) -> tuple[Column, Column]:
    """Grid cell of a Web Mercator point at a zoom."""
    world = float(tile_px * 2**zoom)
    s = F.sin(F.radians(lat))
    x = (lng / 360 + 0.5) * world
    y = (0.5 - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * world
    return F.floor(x / radius_px), F.floor(y / radius_px)


PATH_PART = r"[mMzZ]|-?\d*\.?\d+(?:[eE][-+]?\d+)?"


def absolute_paths(path: Column) -> Column:
    """Closed outlines of a path of m, M and z commands: array<array<struct<x, y>>>; a path starts where the last one began."""
    tokens = F.regexp_extract_all(path, F.lit(f"({PATH_PART})"), F.lit(1))
    point = "struct<x:double,y:double>"
    state = F.struct(
        F.lit("M").alias("mode"), F.lit(None).cast("double").alias("half"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"),
        F.array().cast(f"array<{point}>").alias("open"), F.array().cast(f"array<array<{point}>>").alias("done"),
    )

    def keep(s: Column, **new) -> Column:
        return F.struct(*[new.get(c, s[c]).alias(c) for c in ("mode", "half", "x", "y", "open", "done")])

    def step(s: Column, t: Column) -> Column:
        number = t.try_cast("double")
        flushed = F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"])
        none = F.array().cast(f"array<{point}>")
        start = F.try_element_at(s["open"], F.lit(1))
        closed = keep(s, done=flushed, open=none, x=F.coalesce(start["x"], s["x"]), y=F.coalesce(start["y"], s["y"]), half=F.lit(None).cast("double"))
        moved = keep(s, mode=t, done=flushed, open=none, half=F.lit(None).cast("double"))
        relative = s["mode"] == "m"
        x = F.when(relative, s["x"] + s["half"]).otherwise(s["half"])
        y = F.when(relative, s["y"] + number).otherwise(number)
        drawn = keep(s, half=F.lit(None).cast("double"), x=x, y=y, open=F.concat(s["open"], F.array(F.struct(x.alias("x"), y.alias("y")))))
        return F.when(F.lower(t) == "z", closed).when(F.lower(t) == "m", moved).when(s["half"].isNull(), keep(s, half=number)).otherwise(drawn)

    return F.aggregate(tokens, state, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))


def path_supported(path: Column) -> Column:
    """Whether a path has only the commands that `absolute_paths` reads."""
    return ~F.regexp_like(path, F.lit(r"[a-df-ln-yA-DF-LN-Y]"))


def centroid(points: Column) -> Column:
    n = F.size(points)
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[c]) / n
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def westernmost(paths: Column) -> Column:
    """The outline whose centroid lies furthest west."""
    return F.array_min(F.transform(paths, lambda p: F.struct(centroid(p)["x"].alias("at"), p.alias("path"))))["path"]


def outline_checks(shapes: DataFrame, shape_col: str = "d") -> DataFrame:
    """(check, ok): whether the country's drawn districts are eight, absolute, closed and on the canvas, with Judea and Samaria and without Gaza."""
    d, o = F.col(shape_col), OUTLINE
    pairs = F.transform(F.regexp_extract_all(d, F.lit(r"[ML] (-?[\d.]+,-?[\d.]+)"), F.lit(1)), lambda p: F.split(p, ","))
    points = F.transform(pairs, lambda p: F.struct(p[0].cast("double").alias("x"), p[1].cast("double").alias("y")))
    found = shapes.select(d.alias("d"), points.alias("points")).withColumn("c", centroid(F.col("points")))
    lng = o["lng_lo"] + F.col("c.x") / o["width"] * (o["lng_hi"] - o["lng_lo"])
    lat = o["lat_hi"] - F.col("c.y") / o["height"] * (o["lat_hi"] - o["lat_lo"])
    inside = F.forall("points", lambda p: p["x"].between(0.0, o["width"]) & p["y"].between(0.0, o["height"]))
    absolute = F.col("d").startswith("M ") & ~F.regexp_like("d", F.lit("[mlhvcsqtaz] "))
    checks = {
        "eight": F.count("*") == 8, "absolute": F.bool_and(absolute), "closed": F.bool_and(F.col("d").endswith(" Z")), "inside": F.bool_and(inside),
        "judea_and_samaria": F.bool_or((lng > 35.0) & (lng < 35.5) & (lat > 31.7) & (lat < 32.3)), "no_gaza": ~F.bool_or((lng < 34.6) & (lat > 31.2) & (lat < 31.6)),
    }
    wide = found.agg(*[F.coalesce(v, F.lit(False)).alias(k) for k, v in checks.items()])
    return wide.select(F.explode(F.create_map(*[x for k in checks for x in (F.lit(k), F.col(k))])).alias("check", "ok"))
