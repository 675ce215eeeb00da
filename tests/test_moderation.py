"""Trust states where moderators act among the reports, against a fold of the log, event by event."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from placemill.operators import trust

START = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)


def folded(place, log, days):
    """(status, confirms, reports, confirmed) of one place after its log of (at, id, kind, who)."""
    _, source, status, confirms, reports = place
    vouchers, failed, confirmed = set(), [], None
    for at, _, kind, who in sorted(log, key=lambda e: (e[0], e[1], e[2], e[3] or "")):
        if kind in ("confirm", "new_submission"):
            vouchers.add(who)
            confirms, confirmed = len(vouchers), at
            if status == "pending" and len(vouchers) >= 2:
                status = "published"
        elif kind == "not_working":
            failed.append((who, at))
            reports = len({w for w, t in failed if t > at - days * DAY})
            if status == "published" and reports >= (1 if source == "user_submission" and confirms <= 1 else 3):
                status = "reported_not_working"
        elif kind in ("approve", "locate"):
            status = "published"
        elif kind == "reject":
            status = "rejected"
        elif kind == "restore":
            status, failed, reports = "published", [], 0
    return status, confirms, reports, confirmed


@pytest.mark.parametrize(("seed", "kinds"), [(1, ["approve", "reject", "restore", "locate", "edit"]), (2, ["restore"]), (3, ["reject", "restore"]), (4, [])])
def test_states_are_those_of_the_fold(spark, seed, kinds):
    draw = random.Random(seed)
    places = [(k, draw.choice(["user_submission", "pdf_import"]), draw.choice(["pending", "published", "rejected", "reported_not_working"]), draw.randint(0, 3), draw.randint(0, 3)) for k in range(300)]
    when = lambda: START + draw.randint(0, 40) * DAY + datetime.timedelta(hours=draw.choice([0, 0, 12]))
    reports = [(k, draw.randrange(300), draw.choice(["confirm", "not_working", "not_working", "new_submission"]), draw.choice("abcde"), when(), draw.choice([None, None, None, START])) for k in range(4000)]
    acts = [(10_000 + k, draw.randrange(300), draw.choice(kinds), when()) for k in range(700 if kinds else 0)]
    logs = {k: [] for k in range(300)}
    for i, p, kind, who, at, gone in reports:
        if gone is None:
            logs[p].append((at, i, kind, who))
    for i, p, kind, at in acts:
        logs[p].append((at, i, kind, None))
    frame = spark.createDataFrame(places, "id long, source string, status string, confirm_count int, report_count int")
    log = spark.createDataFrame(reports, "id long, place_id long, kind string, reporter string, created_at timestamp_ntz, superseded_at timestamp_ntz").repartition(3)
    done = spark.createDataFrame(acts, "id long, place_id long, action string, created_at timestamp_ntz")
    got = {r["id"]: tuple(r)[1:] for r in trust.trust_state(frame, log, 5, done).collect()}
    assert got == {p[0]: folded(p, logs[p[0]], 5) for p in places}
    if not kinds:
        assert got == {r["id"]: tuple(r)[1:] for r in trust.trust_state(frame, log, 5).collect()}


def test_a_place_of_very_many_reports(spark):
    """No list of a place's events is made: a million reports of one place, with acts between them."""
    n = 1_000_000
    log = spark.range(n).select("id", F.lit(1).cast("long").alias("place_id"), F.when(F.col("id") % 3 == 0, "confirm").otherwise("not_working").alias("kind"), (F.col("id") % 50_000).cast("string").alias("reporter"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).cast("timestamp_ntz").alias("created_at"))
    places = spark.createDataFrame([(1, "pdf_import", "pending")], "id long, source string, status string")
    acts = spark.createDataFrame([(n + 1, 1, "restore")], "id long, place_id long, action string").withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000 + n - 3)).cast("timestamp_ntz"))
    plan = trust.trust_state(places, log, 5, acts)
    assert "collect_" not in plan._jdf.queryExecution().executedPlan().toString()
    # the act comes after the third last report in time; of the two after it, the first is a failure and the last a vouch
    assert tuple(plan.collect()[0])[:4] == (1, "published", 50_000, 1)


def test_failures_of_one_time_see_one_another(spark):
    rows = [(k, 1, "not_working", who, START + DAY * d) for k, (who, d) in enumerate([("a", 0), ("b", 0), ("a", 3), ("c", 5), ("c", 5), ("d", 20)])]
    frame = spark.createDataFrame(rows, "id long, place_id long, kind string, reporter string, created_at timestamp_ntz")
    assert {r["id"]: r["failures"] for r in trust.trailing_failures(frame, 5).collect()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}
