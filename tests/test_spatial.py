"""The table along the curve: covers hold their circles, and a read skips what is far."""

import random

import pytest
from pyspark.sql import functions as F

from placemill.functions import geo
from placemill.operators import reads, spatial


def key(spark, points):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, lat double, lng double")
    return [r["s"] for r in frame.select("i", spatial.spot(F.col("lat"), F.col("lng")).alias("s")).orderBy("i").collect()]


def test_spots_are_the_bits_in_turn(spark):
    r = random.Random(2)
    points = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(200)] + [(90.0, 180.0), (-90.0, -180.0), (0.0, 0.0)]

    def want(lat, lng):
        x, y = (min(2**20 - 1, int((v - low) / span * 2**20)) for v, low, span in ((lng, -180, 360), (lat, -90, 180)))
        return sum((x >> k & 1) << 2 * k | (y >> k & 1) << 2 * k + 1 for k in range(20))

    assert key(spark, points) == [want(*p) for p in points]


@pytest.mark.parametrize(("lat", "lng"), [(31.8, 35.2), (0.0, 179.99), (10.0, -179.99), (89.7, 20.0), (-45.0, 0.0)])
def test_a_cover_holds_its_circle(spark, lat, lng):
    r = random.Random(3)
    for radius in (100.0, 3_000.0, 25_000.0):
        ranges = spatial.cover(lat, lng, radius)
        assert len(ranges) <= spatial.RANGES and all(a <= b for a, b in ranges) and all(x[1] < y[0] for x, y in zip(ranges, ranges[1:], strict=False))
        d = radius / 110_574
        points = [(max(-90.0, min(90.0, lat + r.uniform(-d, d))), (lng + r.uniform(-3 * d, 3 * d) + 180) % 360 - 180) for _ in range(300)]
        frame = spark.createDataFrame(points, "lat double, lng double").withColumn("m", geo.geodesic_m(F.col("lat"), F.col("lng"), lat, lng)).withColumn("s", spatial.spot(F.col("lat"), F.col("lng")))
        inside = [x["s"] for x in frame.filter(F.col("m") <= radius).collect()]
        assert inside and all(any(a <= s <= b for a, b in ranges) for s in inside)


def test_a_read_skips_row_groups(spark, tmp_path):
    n = 200_000
    every = spark.range(n).select(
        "id", F.concat(F.lit("p"), F.col("id").cast("string")).alias("name_he"), (29.4 + F.pmod(F.xxhash64("id"), F.lit(40_000)) / 10_000).alias("lat"), (34.2 + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(17_000)) / 10_000).alias("lng"), F.lit("published").alias("status"),
        F.lit("cafe").alias("category"), F.lit(True).alias("benefit_fighter_card"), F.lit(False).alias("benefit_vacation_voucher"),
    )
    path = str(tmp_path / "curve")
    spatial.write(every.union(every.limit(5).withColumns({"id": F.col("id") + n, "lat": F.lit(None).cast("double")})), path, files=40)
    at = (31.5, 35.0, 3_000.0)
    scan = spatial.around(spark, path, *at)
    found = scan.collect()
    leaf = scan._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    read = leaf.metrics().apply("numOutputRows").value()
    assert len(found) < read < n / 5, read  # most files' row groups are skipped
    got, want = ([tuple(r) for r in f.select("id", "distance_m").collect()] for f in (spatial.places_near(spark, path, *at), reads.places_near(every, *at)))
    assert got == want and len(got) > 50
