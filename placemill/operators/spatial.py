"""A table of places sorted along a space-filling curve, and reads of a circle that skip the rest of it.

A point's `spot` is its cell in a grid of 2 ** BITS by 2 ** BITS over the whole earth, by the bits of its column and row in turn (Z order), so near points mostly
have near numbers.  A table that is sorted by it has row groups of narrow ranges; a circle is covered by a few ranges of spots, plain comparisons that reach the
scan, which then reads only the row groups that they meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.operators import reads

#: Bits of each axis: cells of at most 38 m.
BITS = 20
#: Ranges that cover a circle, at most; fewer ranges cover more, and never less.
RANGES = 48
#: Bytes of a row group.
GROUP_BYTES = 16 << 20


def _cell(degrees: Column, low: float, span: float) -> Column:
    return F.least(F.greatest(F.floor((degrees - low) / span * 2**BITS), F.lit(0)), F.lit(2**BITS - 1)).cast("long")


def _spread(x: Column) -> Column:
    """The bits of a number of up to 32 bits, with a zero after each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def spot(lat: Column, lng: Column) -> Column:
    """The place of a point along the curve; null without a point."""
    return _spread(_cell(lng, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(_cell(lat, -90.0, 180.0)), 1))


def cover(lat: float, lng: float, radius_m: float, most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of spots, both ends included, in ascending order, that hold every point within the radius: squares that meet the circle's box are split in four, the largest first, while there are few."""
    d_lat = radius_m / geo.DEGREE_M
    widest = abs(lat) + d_lat
    d_lng = 180.0 if widest >= 89.9 else min(180.0, d_lat / math.cos(math.radians(widest)))
    # a box over the date line is two
    west, east = lng - d_lng, lng + d_lng
    boxes = [(max(west, -180.0), min(east, 180.0))] + [(west + 360, 180.0)] * (west < -180) + [(-180.0, east - 360)] * (east > 180)
    at = lambda v, low, span: min(max(math.floor((v - low) / span * 2**BITS), 0), 2**BITS - 1)
    rows = at(lat - d_lat, -90.0, 180.0), at(lat + d_lat, -90.0, 180.0)
    columns = [(at(w, -180.0, 360.0), at(e, -180.0, 360.0)) for w, e in boxes]

    def meets(x: int, y: int, size: int) -> bool:
        return y <= rows[1] and y + size > rows[0] and any(x <= e and x + size > w for w, e in columns)

    def inside(x: int, y: int, size: int) -> bool:
        return rows[0] <= y and y + size - 1 <= rows[1] and any(w <= x and x + size - 1 <= e for w, e in columns)

    def first(x: int, y: int) -> int:
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(BITS))

    open_, done = [(2**BITS, 0, 0)], []
    while open_ and len(open_) + len(done) + 3 <= most:
        open_.sort()
        size, x, y = open_.pop()
        if size == 1 or inside(x, y, size):
            done.append((size, x, y))
            continue
        half = size // 2
        open_ += [(half, a, b) for a in (x, x + half) for b in (y, y + half) if meets(a, b, half)]
    ranges: list[tuple[int, int]] = []
    for low, size in sorted((first(x, y), size) for size, x, y in [*open_, *done]):
        if ranges and ranges[-1][1] + 1 == low:
            ranges[-1] = (ranges[-1][0], low + size * size - 1)
        else:
            ranges.append((low, low + size * size - 1))
    return ranges


def write(places: DataFrame, path: str, files: int | None = None) -> None:
    """places as a table in the order of the curve; those without a point come first."""
    parts = files or int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = places.withColumn("spot", spot(F.col("lat"), F.col("lng")))
    keyed.repartitionByRange(parts, F.asc_nulls_first("spot")).sortWithinPartitions(F.asc_nulls_first("spot")).write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def around(spark: SparkSession, path: str, lat: float, lng: float, radius_m: float) -> DataFrame:
    """The rows of such a table in the ranges that cover the circle, and so all within it."""
    held = F.lit(False)
    for low, high in cover(lat, lng, radius_m):
        held = held | F.col("spot").between(low, high)
    return spark.read.parquet(path).filter(held)


def places_near(spark: SparkSession, path: str, lat: float, lng: float, radius_m: float = 25_000, **options) -> DataFrame:
    """`reads.places_near` on a table that `write` made."""
    return reads.places_near(around(spark, path, lat, lng, radius_m).drop("spot"), lat, lng, radius_m, **options)
