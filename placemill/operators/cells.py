"""Cells of a sheet: unpivot, difference to a snapshot, and its check.

Rows have row, reported_at (ISO text or null) and the two benefit fields; a cell is (row, reported_at, field, text).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placemill.functions import text

FIELDS = ["vacation_voucher", "fighter_card"]


def cells(rows: DataFrame) -> DataFrame:
    """A row for each cell that isn't blank."""
    stacked = rows.select("row", "reported_at", F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in FIELDS])))
    return stacked.withColumn("text", F.trim("text")).filter("text <> ''")


def occurrences(rows: DataFrame) -> DataFrame:
    """(text, occurrences, n): each distinct text with where it stands, in order."""
    at = F.sort_array(F.collect_list(F.struct(F.col("row"), F.col("field").alias("benefit"), F.col("reported_at"))))  # what a record carries as its sources
    return cells(rows).groupBy("text").agg(at.alias("occurrences"), F.count("*").alias("n"))


def marked(found: DataFrame) -> DataFrame:
    return found.withColumn("print", text.fingerprint(F.col("text")))


def diff(new: DataFrame, known: DataFrame) -> DataFrame:
    """Cells of new whose fingerprint no cell of known has; repeated new ones all stay."""
    return marked(new).join(marked(known).select("print").distinct(), "print", "left_anti")


def snapshot_end(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max("reported_at").alias("snapshot_end"))


def verify(new: DataFrame, added: DataFrame, end: str) -> DataFrame:
    """Cells reported after the snapshot that matched it all the same: each is a false match."""
    late = new.filter(F.col("reported_at") > end)
    return late.join(added.select("row", "field").distinct(), ["row", "field"], "left_anti")


def diff_summary(new: DataFrame, added: DataFrame, end: str) -> DataFrame:
    by = added.groupBy("field").agg(F.count("*").alias("added"), F.count_if(F.col("reported_at") > end).alias("newer"))
    return new.groupBy("field").agg(F.count("*").alias("cells")).join(by, "field", "left").na.fill(0)


def to_raw_rows(added: DataFrame) -> DataFrame:
    """Added cells as rows with one benefit each and no page."""
    return added.select("row", "reported_at", F.lit(None).cast("int").alias("page"), *[F.when(F.col("field") == f, F.col("text")).alias(f) for f in FIELDS])


def missing_from_cache(found: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """Texts whose answer the cache (cache_key, places) doesn't hold."""
    keyed = found.withColumn("cache_key", text.cache_key(version, model, F.col("text")))
    return keyed.join(cache.select("cache_key"), "cache_key", "left_anti")


def from_cache(found: DataFrame, cache: DataFrame, version: str, model: str) -> DataFrame:
    """found with the places that the cache (cache_key, places) has for each text; the others are `missing_from_cache`."""
    return found.withColumn("cache_key", text.cache_key(version, model, F.col("text"))).join(cache.select("cache_key", "places"), "cache_key")
