"""Dates and freshness as Column expressions; nothing reads the clock, `as_of` is a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STALE_DAYS, FRESH_DAYS = 183, 30
TIME_FIRST = r"(\d{1,2}):(\d{2}):(\d{2})\D+(\d{1,2})/(\d{1,2})/(\d{4})"
DATE_FIRST = r"(\d{1,2})/(\d{1,2})/(\d{4})\D+(\d{1,2}):(\d{2}):(\d{2})"
HEBREW_MONTHS = ["ינואר", "פברואר", "מרץ", "אפריל", "מאי", "יוני", "יולי", "אוגוסט", "ספטמבר", "אוקטובר", "נובמבר", "דצמבר"]


def parse_timestamp(cell: Column) -> Column:
    """ISO text of the first time and date in a cell, in either order; ranges are checked, the calendar isn't."""
    both = F.regexp_extract(cell, f"{TIME_FIRST}|{DATE_FIRST}", 0)
    early = F.regexp_like(both, F.lit(f"^{TIME_FIRST}"))
    of = lambda pattern, k: F.regexp_extract(both, pattern, k).try_cast("int")
    h, mi, s, d, mo, y = (F.when(early, of(f"^{TIME_FIRST}", a)).otherwise(of(f"^{DATE_FIRST}", b)) for a, b in ((1, 4), (2, 5), (3, 6), (4, 1), (5, 2), (6, 3)))
    fits = mo.between(1, 12) & d.between(1, 31) & (h < 24) & (mi < 60) & (s < 60)
    return F.when(fits, F.format_string("%04d-%02d-%02dT%02d:%02d:%02d", y, mo, d, h, mi, s))


def parse_stamp(cell: Column) -> Column:
    """ISO text of a day/month/year time; null if it isn't one of the calendar."""
    return F.date_format(F.try_to_timestamp(F.trim(cell), F.lit("d/M/yyyy H:m:s")), "yyyy-MM-dd'T'HH:mm:ss")


def last_signal(last_confirmed: Column, first_reported: Column) -> Column:
    return F.coalesce(last_confirmed, first_reported)


def _days(last_confirmed: Column, as_of: Column) -> Column:
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(last_confirmed.cast("timestamp"))) / 86_400_000_000


def is_stale(last_confirmed: Column, as_of: Column) -> Column:
    return F.coalesce(_days(last_confirmed, as_of) > STALE_DAYS, F.lit(False))


def is_fresh(last_confirmed: Column, as_of: Column) -> Column:
    return F.coalesce(_days(last_confirmed, as_of) <= FRESH_DAYS, F.lit(False))


def is_single_source(source: Column, confirm_count: Column) -> Column:
    return (source == "user_submission") & (confirm_count <= 1)


def display_date(at: Column, zone: str = "Asia/Jerusalem") -> Column:
    """Day, month and year in the country's own time."""
    local = F.from_utc_timestamp(at, zone)
    month = F.element_at(F.array(*[F.lit(m) for m in HEBREW_MONTHS]), F.month(local))
    return F.concat(F.dayofmonth(local).cast("string"), F.lit(" ב"), month, F.lit(" "), F.year(local).cast("string"))
