"""Intervals and markers laid over a date window, and the geometry of charts. All of it is plain columns and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlapping(intervals: DataFrame, since: Column, until: Column) -> DataFrame:
    """Intervals (started_on, stopped_on) that meet the window, ends included; one without an end is still open."""
    return intervals.where((F.col("started_on") <= until) & (F.col("stopped_on").isNull() | (F.col("stopped_on") >= since)))


#: Days of a bucket in which dates and ranges meet.
BUCKET_DAYS = 32


def dates_in_ranges(dates: DataFrame, at: str, ranges: DataFrame, first: str, last: str) -> DataFrame:
    """Every date of `dates` with every range of `ranges` that holds it, ends included.

    Both meet in buckets of days by an equi-join: a date lies in one, a range in all that it touches, so a pair comes once.
    A bucket that many share is split by Spark like any skewed key. Null dates and ends, and ranges that end before they begin,
    meet nothing; columns of both sides must have different names."""
    bucket = lambda c: F.floor(F.unix_date(c) / BUCKET_DAYS)
    spread = ranges.where(F.col(first) <= F.col(last)).withColumn("_bucket", F.explode(F.sequence(bucket(first), bucket(last))))
    return dates.withColumn("_bucket", bucket(at)).join(spread, "_bucket").where(F.col(at).between(F.col(first), F.col(last))).drop("_bucket")


def overlapping_pairs(windows: DataFrame, since: str, until: str, intervals: DataFrame, started: str, stopped: str) -> DataFrame:
    """Every window (since, until) with every interval (started, stopped) that meets it; an interval without an end is open.

    Either the interval starts inside the window, or the window starts after it and inside it, never both; so two joins of dates
    with ranges hold all pairs once, without a nested loop. An open interval ends with the last window."""
    last = windows.agg(F.max(until)).first()[0]
    held = intervals.withColumn("_stop", F.coalesce(stopped, F.lit(last).cast("date")))
    inside = dates_in_ranges(held, started, windows, since, until).where(F.col("_stop") >= F.col(since))
    before = dates_in_ranges(windows, since, held.withColumn("_after", F.date_add(started, 1)), "_after", "_stop").drop("_after")
    return inside.unionByName(before.where(F.col(until) >= F.col(since))).drop("_stop")


def shown_markers(markers: DataFrame, bands: DataFrame) -> DataFrame:
    """Markers without an interval, and those whose interval is among the bands.

    The bands' ids are distinct before an equi-join, so no marker repeats; Spark broadcasts them if they are few.
    """
    ids = bands.select(F.col("user_id").alias("band")).distinct()
    return markers.join(ids, F.col("interval_id") == F.col("band"), "left").where("interval_id is null or band is not null").drop("band")


def padded(lo: Column, hi: Column, share: float = 0.15, part: float = 0.1) -> tuple[Column, Column]:
    """Axis ends: padded by a share of the span, of `part` of the upper value, or of 1, whichever is most."""
    pad = F.greatest(hi - lo, F.abs(hi) * part, F.lit(1.0)) * share
    return lo - pad, hi + pad


def padded_from_zero(lo: Column, hi: Column, share: float = 0.1) -> tuple[Column, Column]:
    """Axis ends for print: a flat series gets a span of its own, and values that aren't negative no axis below 0."""
    pad = F.when(lo == hi, F.greatest(F.abs(hi) * 0.1, F.lit(1.0))).otherwise(hi - lo) * share
    return F.when(lo >= 0, F.greatest(F.lit(0.0), lo - pad)).otherwise(lo - pad), hi + pad


def scaled(value: Column, lo: Column, hi: Column, height: float = 24.0, pad: float = 2.0) -> Column:
    """Height of a value in a box whose origin is at the top."""
    return height - pad - (value - lo) / F.greatest(F.lit(1e-9), hi - lo) * (height - 2 * pad)


def compare_padded(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Axis ends of a comparison: 12 % of the span, or 1 for a flat series."""
    pad = F.when(hi > lo, (hi - lo) * 0.12).otherwise(F.lit(1.0))
    return lo - pad, hi + pad


def date_padded(lo: Column, hi: Column) -> tuple[Column, Column]:
    """Ends of a time axis in seconds, from those of the dates: 4 % of the span, or 30 days for a single date."""
    a, b = F.unix_timestamp(lo.cast("timestamp")), F.unix_timestamp(hi.cast("timestamp"))
    pad = F.when(b > a, (b - a) * 0.04).otherwise(F.lit(30.0 * 86400))
    return a - pad, b + pad


def event_text(kind: Column, name: Column, old: Column, new: Column) -> Column:
    """The text of an emitted event; null where a command emits none, as a change to the same dose."""
    return (
        F.when(kind == "start", F.concat(F.lit("Started "), name, F.lit(" ("), new, F.lit(")"))).when(kind == "stop", F.concat(F.lit("Stopped "), name))
        .when((kind == "change") & (old != new), F.concat(F.lit("Changed "), name, F.lit(": "), old, F.lit(" to "), new))
    )
