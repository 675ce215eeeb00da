"""The trust state of places from their reports.

`reports` has id, place_id, kind (confirm, new_submission, not_working), reporter and created_at; `places` has id, source, status and
optionally confirm_count and report_count.  Reports count in the order (created_at, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placemill.functions import dates

VOUCHES = ["confirm", "new_submission"]
# Fixed values.
WINDOW_DAYS, TO_PUBLISH, TO_FLAG, TO_FLAG_SINGLE = 60, 2, 3, 1
RATE_LIMIT, RATE_SECONDS = 5, 3600
#: What an act of locating sets, and what an edit may set.
LOCATES, EDITS = ["provider_ref", "lat", "lng", "address_he", "city"], ["city", "name_he", "category", "benefit_fighter_card", "benefit_vacation_voucher", "note_he"]


def is_vouch() -> Column:
    return F.col("kind").isin(*VOUCHES)


def _open(reports: DataFrame) -> Column:
    return F.col("superseded_at").isNull() if "superseded_at" in reports.columns else F.lit(True)


def vouch_counts(reports: DataFrame) -> DataFrame:
    n = F.countDistinct(F.when(is_vouch() & _open(reports), F.col("reporter")))
    return reports.groupBy("place_id").agg(n.alias("vouches"))


def failure_counts(reports: DataFrame, as_of: str, days: int = WINDOW_DAYS) -> DataFrame:
    """Distinct reporters of open failures less than `days` old."""
    recent = F.col("created_at") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    n = F.countDistinct(F.when((F.col("kind") == "not_working") & _open(reports) & recent, F.col("reporter")))
    return reports.groupBy("place_id").agg(n.alias("failures"))


def running_vouches(reports: DataFrame) -> DataFrame:
    """The distinct vouchers of a place so far, at each vouch: first vouches of a reporter, summed."""
    order = ["created_at", "id"]
    first = F.row_number().over(Window.partitionBy("place_id", "reporter").orderBy(*order)) == 1
    own = Window.partitionBy("place_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return reports.filter(is_vouch()).withColumn("_first", first.cast("int")).withColumn("vouches", F.sum("_first").over(own)).drop("_first")


def trailing_failures(reports: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """The distinct reporters of a place's failures in the last `days` before each failure, itself included and the far end not.

    Failures of one time see one another, so a failure has the count of the last one of its time.
    """
    failed = reports.filter("kind = 'not_working'")
    counts = running_failures(failed, days).groupBy("place_id", "at").agg(F.max_by("failures", "id").alias("failures"))
    timed = failed.withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")))
    return timed.join(counts, ["place_id", "at"]).select(*reports.columns, F.col("failures").cast("int").alias("failures"))


def running_failures(reports: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """(place_id, at, id, vouch, vouches, failures) of each report in the order (at, id): a place's distinct vouchers so far, and the distinct reporters of its failures in the last `days`.

    A reporter's failure counts until it is `days` old, so a period begins with a failure that none of the same reporter comes before in time, and
    ends with one that none follows in time: sums of beginnings and endings, without sets of reporters.
    """
    span = days * 86_400_000_000
    rows = reports.select("place_id", F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"), F.col("id").cast("long").alias("id"), is_vouch().alias("vouch"), (F.col("kind") == "not_working").alias("failure"), "reporter")
    own = Window.partitionBy("place_id", "reporter", "vouch", "failure").orderBy("at", "id")
    rows = rows.filter("vouch OR failure").withColumns({"n": F.row_number().over(own), "before": F.lag("at").over(own), "after": F.lead("at").over(own)})
    begins = F.col("failure") & (F.col("before").isNull() | (F.col("before") <= F.col("at") - span))
    ends = F.col("failure") & (F.col("after").isNull() | (F.col("after") >= F.col("at") + span))
    row = F.struct("at", F.lit(1).alias("side"), "id", "vouch", (F.col("vouch") & (F.col("n") == 1)).cast("int").alias("more"), begins.cast("int").alias("open"))
    end = F.struct((F.col("at") + span).alias("at"), F.lit(0).alias("side"), "id", F.lit(None).cast("boolean").alias("vouch"), F.lit(0).alias("more"), F.lit(-1).alias("open"))
    events = rows.select("place_id", F.inline(F.when(ends, F.array(row, end)).otherwise(F.array(row))))
    place = Window.partitionBy("place_id").orderBy("at", "side", "id").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"vouches": F.sum("more").over(place), "failures": F.sum("open").over(place)})
    return events.filter("side = 1").select("place_id", "at", "id", "vouch", "vouches", "failures")


def trust_state(places: DataFrame, reports: DataFrame, days: int = WINDOW_DAYS, moderation: DataFrame | None = None) -> DataFrame:
    """(id, status, confirm_count, report_count, last_confirmed_at) after all reports, from running counts: windows and one row a place.

    Vouches publish a pending place at TO_PUBLISH reporters.  Failures flag a published one at TO_FLAG, or at TO_FLAG_SINGLE where it stands on one
    submitter's word before the event; a flag is never taken back by reports.  report_count is that of the last failure.  Reports that are superseded
    (superseded_at, if there is such a column) don't count.
    moderation (id, place_id, action approve/reject/restore/locate, created_at) joins the same order; restore closes open failures.
    """
    reports = reports.filter(_open(reports))
    c = F.col
    zero = lambda n: (F.coalesce(c(n), F.lit(0)) if n in places.columns else F.lit(0)).cast("int")
    most = lambda k: F.max(F.when(~c("vouch") & k, c("failures")))
    if moderation is not None:
        counts = _moderated(reports, days, moderation)
    else:
        counts = running_failures(reports, days).groupBy("place_id").agg(
            most(c("vouches") == 0).alias("alone"), most(c("vouches") == 1).alias("one"), most(c("vouches") > 1).alias("more"), F.max("vouches").alias("n"),
            F.max(F.when(c("vouch"), c("at"))).alias("confirmed"), F.max_by(F.when(~c("vouch"), c("failures")), F.when(~c("vouch"), F.struct("at", "id"))).alias("last"),
        ).withColumn("act", F.lit(None).cast("string"))
    known = places.join(counts, places["id"] == counts["place_id"], "left")
    begins = F.when(c("act").isNull(), c("status")).when(c("act") == "reject", "rejected").otherwise("published")  # what the last act says
    submitted = c("source") == "user_submission"
    few = F.when(submitted & (zero("confirm_count") <= 1), TO_FLAG_SINGLE).otherwise(TO_FLAG)  # before the first vouch the count that a place came with decides
    yes = lambda x: F.coalesce(x, F.lit(False))
    early = yes(c("alone") >= few) | yes(c("one") >= F.when(submitted, TO_FLAG_SINGLE).otherwise(TO_FLAG))
    hit = ((begins == "published") & early) | (begins.isin("published", "pending") & yes(c("more") >= TO_FLAG))
    status = F.when(hit, "reported_not_working").when((begins == "pending") & (c("n") >= TO_PUBLISH), "published").otherwise(begins)
    confirms = F.when(c("n") > 0, c("n").cast("int")).otherwise(zero("confirm_count"))
    return known.select("id", status.alias("status"), confirms.alias("confirm_count"), F.coalesce(c("last").cast("int"), zero("report_count")).alias("report_count"), F.timestamp_micros("confirmed").alias("last_confirmed_at"))


def _moderated(reports: DataFrame, days: int, moderation: DataFrame) -> DataFrame:
    """What `trust_state` needs of each place where moderators act among the reports, from running counts over segments of its log.

    An act sets the status whatever came before it, so only what follows the last act decides, and a restore closes the failures before it.  So a log is cut
    at its acts (`part`) and at its restores (`open_part`), by running counts of both; failures are counted inside the stretch between restores, vouches
    over the whole log, and a place's status is that of its last part.  No list of a place's events is made anywhere.
    """
    c, span = F.col, days * 86_400_000_000
    at = F.unix_micros(F.col("created_at").cast("timestamp"))
    acts = moderation.filter(F.col("action").isin("approve", "reject", "restore", "locate"))
    events = reports.filter(is_vouch() | (F.col("kind") == "not_working")).select("place_id", at.alias("at"), F.col("id").cast("long").alias("id"), "kind", F.col("reporter").cast("string").alias("who"), F.lit(0).alias("act"))
    events = events.unionByName(acts.select("place_id", at.alias("at"), F.col("id").cast("long").alias("id"), F.col("action").alias("kind"), F.lit(None).cast("string").alias("who"), F.lit(1).alias("act")))
    order = ["at", "id", "kind", "who"]
    so_far = Window.partitionBy("place_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({"part": F.sum("act").over(so_far), "open_part": F.sum((c("kind") == "restore").cast("int")).over(so_far)})
    vouch, failure = is_vouch(), c("kind") == "not_working"
    # a voucher counts at the first vouch of all; a reporter's failures of one stretch are periods that begin and end
    own = Window.partitionBy("place_id", "who", F.when(vouch, -1).otherwise(F.when(failure, c("open_part")).otherwise(-2))).orderBy(*order)
    events = events.withColumns({"n": F.row_number().over(own), "before": F.lag("at").over(own), "after": F.lead("at").over(own)})
    begins = failure & (c("before").isNull() | (c("before") <= c("at") - span))
    ends = failure & (c("after").isNull() | (c("after") >= c("at") + span))
    row = F.struct("at", F.lit(1).alias("side"), "id", "kind", "who", "act", "part", (vouch & (c("n") == 1)).cast("int").alias("more"), begins.cast("int").alias("open"))
    end = F.struct((c("at") + span).alias("at"), F.lit(0).alias("side"), "id", "kind", "who", F.lit(0).alias("act"), "part", F.lit(0).alias("more"), F.lit(-1).alias("open"))
    counted = events.select("place_id", "open_part", F.inline(F.when(ends, F.array(row, end)).otherwise(F.array(row))))
    line = ["at", "side", "id", "kind", "who"]
    place = Window.partitionBy("place_id").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    stretch = Window.partitionBy("place_id", "open_part").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    counted = counted.withColumns({"vouches": F.sum("more").over(place), "failures": F.sum("open").over(stretch)}).filter("side = 1")
    most = lambda k: F.max(F.when(failure & k, c("failures")))
    parts = counted.groupBy("place_id", "part").agg(
        most(c("vouches") == 0).alias("alone"), most(c("vouches") == 1).alias("one"), most(c("vouches") > 1).alias("more"), F.max("vouches").alias("n"), F.max(F.when(c("act") == 1, c("kind"))).alias("act"),
        F.max(F.when(vouch, c("at"))).alias("confirmed"), F.max(F.when(failure | (c("kind") == "restore"), F.struct(*order, F.when(failure, c("failures")).otherwise(0).alias("reports")))).alias("last"),
    )
    final = F.max_by(F.struct("alone", "one", "more", "act"), "part")
    return parts.groupBy("place_id").agg(final.alias("f"), F.max("n").alias("n"), F.max("confirmed").alias("confirmed"), F.max("last").alias("last")).select("place_id", "f.*", "n", "confirmed", F.col("last.reports").alias("last"))


def edited(places: DataFrame, moderation: DataFrame) -> DataFrame:
    """places with what moderators changed: of each field the last act that sets it wins.

    moderation has id, place_id, action, created_at and any of provider_ref, lat, lng, address_he, city, name_he, category.  `locate` puts a place at a
    doorway: the point is exact and no longer missing, and the address and the town are the act's, also where it has none.
    """
    fields = [f for f in LOCATES + EDITS[1:] if f in moderation.columns and f in places.columns]
    order, located = F.struct("created_at", "id"), F.col("action") == "locate"
    sets = lambda f: (located & F.lit(f in LOCATES)) | ((F.col("action") == "edit") & F.lit(f in EDITS) & F.col(f).isNotNull())
    acts = moderation.filter(F.col("action").isin("locate", "edit")).groupBy("place_id").agg(
        *[F.max_by(F.when(sets(f), F.struct(F.col(f).alias("v"))), F.when(sets(f), order)).alias(f"_{f}") for f in fields], F.bool_or(located).alias("_located")
    )
    joined = places.join(acts, places["id"] == acts["place_id"], "left")
    found = F.coalesce("_located", F.lit(False))
    new = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}")["v"]).otherwise(F.col(f)) for f in fields}
    new |= {"location_precision": F.when(found, "exact").otherwise(F.col("location_precision"))} if "location_precision" in places.columns else {}
    new |= {"pin_unavailable": F.when(found, False).otherwise(F.col("pin_unavailable"))} if "pin_unavailable" in places.columns else {}
    return joined.select(*[new.get(c, F.col(c)).alias(c) for c in places.columns])


def badges(places: DataFrame, as_of: str) -> DataFrame:
    """(id, unverified, single_source, fresh, stale, badge): the badge is the gravest that applies."""
    at, now = F.col("last_confirmed_at"), F.lit(as_of).cast("timestamp")
    single, fresh, stale = dates.is_single_source(F.col("source"), F.col("confirm_count")), dates.is_fresh(at, now), dates.is_stale(at, now)
    badge = F.when(F.col("status") == "reported_not_working", "reported").when(F.col("status") == "pending", "pending").when(single, "single_source").when(stale, "stale").when(fresh, "fresh").otherwise("")
    return places.select("id", at.isNull().alias("unverified"), single.alias("single_source"), fresh.alias("fresh"), stale.alias("stale"), badge.alias("badge"))


def rate_limited(reports: DataFrame, limit: int = RATE_LIMIT, seconds: int = RATE_SECONDS) -> DataFrame:
    """reports with `limited`: whether the reporter had `limit` earlier ones in the last `seconds`, both ends included."""
    order = Window.partitionBy("reporter").orderBy("_at", "id")
    # the report `limit` places before is the one that decides
    nth = F.lag("_at", limit).over(order)
    timed = reports.withColumn("_at", F.unix_micros(F.col("created_at").cast("timestamp")))
    return timed.withColumn("limited", F.coalesce(nth >= F.col("_at") - seconds * 1_000_000, F.lit(False))).drop("_at")


def orphans(reports: DataFrame, places: DataFrame) -> DataFrame:
    return reports.join(places.select(F.col("id").alias("place_id")), "place_id", "left_anti")


def lockouts(attempts: DataFrame, failures: int = 8, minutes: int = 5) -> DataFrame:
    """attempts (who, at, ok) with `locked`: as many failures in the minutes before."""
    own = Window.partitionBy("who").orderBy("_at").rangeBetween(-minutes * 60_000_000, -1)
    timed = attempts.withColumn("_at", F.unix_micros(F.col("at").cast("timestamp")))
    return timed.withColumn("locked", F.coalesce(F.sum((~F.col("ok")).cast("int")).over(own), F.lit(0)) >= failures).drop("_at")
