"""The trust stream: late and repeated batches, and what a batch reads."""

import datetime
import random

from pyspark.sql import functions as F

from placemill.operators import trust
from placemill.streaming import trust_stream

SCHEMA = "id long, place_id long, kind string, reporter string, created_at timestamp_ntz"


def some_reports(seed, n, places):
    draw = random.Random(seed)
    at = lambda: datetime.datetime(2024, 1, 1) + datetime.timedelta(days=draw.randint(0, 100))
    return [(seed * 10_000 + k, draw.choice(places), draw.choice(["confirm", "not_working", "new_submission"]), draw.choice("abcd"), at()) for k in range(n)]


def test_late_batches_are_like_one_batch(spark, tmp_path):
    """Batches whose reports are older than those before, one of them written twice: the states are those of all reports at once."""
    places = spark.createDataFrame([(k, "user_submission", "pending") for k in range(40)], "id long, source string, status string")
    batches = [spark.createDataFrame(some_reports(s, 60, range(40)), SCHEMA) for s in (3, 1, 2)]
    seen, path = {}, str(tmp_path / "log")
    for number, batch in [*enumerate(batches), (2, batches[2])]:
        touched = trust_stream.append(batch, number, path, buckets=16)
        log = trust_stream.read_log(spark, path, touched)
        seen |= {r["id"]: tuple(r) for r in trust_stream.touched_states(places, log, log.filter(F.col("batch_id") == number), 30).collect()}
    every = batches[0].union(batches[1]).union(batches[2])
    want = {r["id"]: tuple(r) for r in trust.trust_state(places, every, 30).collect()}
    assert seen == {k: v for k, v in want.items() if k in seen} and len(seen) > 30


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "log")
    for s in range(3):
        trust_stream.append(spark.createDataFrame(some_reports(s, 300, range(200)), SCHEMA), s, path, buckets=64)
    touched = trust_stream.append(spark.createDataFrame(some_reports(9, 5, [7]), SCHEMA), 9, path, buckets=64)
    log = trust_stream.read_log(spark, path, touched)
    assert len(touched) == 1 and all(f"/bucket={touched[0]}/" in f for f in log.inputFiles()) and len(log.inputFiles()) <= 4
    assert log.filter("place_id = 7").count() == sum(1 for s in range(3) for r in some_reports(s, 300, range(200)) if r[1] == 7) + 5
