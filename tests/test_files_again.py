"""Sheets that are read in splits, and places in an order without one task."""

import csv
import random

from pyspark.sql import functions as F

from placemill.operators.settle import numbered
from placemill.sources import files


def test_split_sheets_are_like_whole_ones(spark, tmp_path):
    """Line breaks, quotes and commas in cells wherever a split may begin."""
    r = random.Random(4)
    word = lambda: r.choice(["a", "b, c", 'say "x"', "one\ntwo", '"\n"', "tail\n\nend", "", "long " * 12])
    for name, n in (("a.csv", 120), ("b.csv", 1), ("c.csv", 60)):
        with (tmp_path / name).open("w", encoding="utf-8", newline="") as out:
            out.write("﻿")
            sheet = csv.writer(out, lineterminator="\n")
            sheet.writerow(["date", "x", "v", "f"])
            for k in range(n):
                sheet.writerow([f"{k % 28 + 1}/2/2024 10:00:00", word(), word(), word()])
    want = sorted(tuple(x) for x in files.sheet_cells(spark, str(tmp_path)).collect())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("97b", "400b", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1b")
            found = files.split_sheet_cells(spark, str(tmp_path))
            assert sorted(tuple(x) for x in found.collect()) == want, size
        spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_places_in_an_order_are_those_of_the_sort(spark):
    frame = spark.range(5000).withColumn("key", F.xxhash64("id"))
    got = {r["id"]: r["place"] for r in numbered(frame.orderBy("key")).select("id", "place").collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda x: x[1])] == [r["id"] for r in frame.orderBy("key").collect()]
    assert sorted(got.values()) == list(range(1, 5001))
