"""Bucket and date strings on a fixed shift from UTC.

Aggregations group on the numeric bucket and format it afterwards, so the string work is done once
per bucket and not once per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from moodstream.functions.text import _column

# The series is kept on UTC+5:30; period names with their hours.
SHIFT_SECONDS = 19800
PERIOD_HOURS = {"1h": 1, "6h": 6, "1d": 24, "1w": 168}
CHART_PERIOD_HOURS = {"1h": 1, "6h": 6, "24h": 24}

BUCKET_SECONDS = {"minute": 60, "hour": 3600}
BUCKET_FORMAT = "yyyy-MM-dd HH:mm"


def bucket_start(epoch: Column | str, unit: str = "minute", shift: int = SHIFT_SECONDS) -> Column:
    """Start of the bucket as whole seconds on the shifted clock."""
    seconds = (_column(epoch) + shift).cast("long")
    return seconds - F.pmod(seconds, F.lit(BUCKET_SECONDS[unit]))


def bucket_label(bucket: Column | str) -> Column:
    """``yyyy-MM-dd HH:mm`` of a bucket start."""
    return F.date_format(F.timestamp_seconds(_column(bucket)), BUCKET_FORMAT)


def utc_day(epoch: Column | str) -> Column:
    """``yyyy-MM-dd`` of an epoch value."""
    return F.date_format(F.timestamp_seconds(_column(epoch)), "yyyy-MM-dd")


def period_cutoff(hours: int, as_of: float | None = None, shift: int = SHIFT_SECONDS) -> Column:
    """Oldest bucket label inside the period; foldable, so it can be pushed into a scan."""
    now = F.unix_timestamp() if as_of is None else F.lit(as_of)
    return bucket_label((now + shift - hours * 3600).cast("long"))


def clock_label(time: Column | str) -> Column:
    """Bucket label as a twelve-hour clock; a label that is not a time is returned unchanged."""
    time = _column(time)
    return F.coalesce(F.date_format(F.try_to_timestamp(time, F.lit(BUCKET_FORMAT)), "hh:mm a"), time)
