"""Days, leases and expiry over timestamps; the time of the question is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def day_stamp(at: Column) -> Column:
    """The day of a time as text, year first."""
    return F.date_format(at, "yyyy-MM-dd")


def seconds_between(a: Column, b: Column) -> Column:
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 1e6


def lease_is_over(taken: Column, now: Column, seconds: float = 1800) -> Column:
    """Whether a lease that was taken once has run out: more than its seconds have passed; one that wasn't taken hasn't."""
    return F.coalesce(seconds_between(taken, now) > seconds, F.lit(False))


def still_valid(issued: Column, now: Column, days: float) -> Column:
    """Whether what was issued for a number of days counts yet, up to its last moment; never without a time."""
    return F.coalesce(seconds_between(issued, now) <= days * 86_400, F.lit(False))


def days_apart(a: Column, b: Column) -> Column:
    """Calendar days from a to b."""
    return F.date_diff(b.cast("date"), a.cast("date"))
