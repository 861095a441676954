"""Elapsed time between zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .numbers import col


def since_epoch(ts: Column | str) -> Column:
    """Seconds since 1970 on the same clock, as a decimal with the microseconds.

    The difference of two zone-free times does not depend on the session zone.
    """
    elapsed = col(ts).cast("timestamp_ntz") - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return elapsed.cast("interval second").cast("decimal(18,6)")


def epoch_seconds(ts: Column | str) -> Column:
    return F.floor(since_epoch(ts)).cast("bigint")


def epoch_double(ts: Column | str) -> Column:
    return since_epoch(ts).cast("double")


def as_instant(ts: Column | str) -> Column:
    """The UTC instant with the same reading: watermarks need one, whatever the session zone."""
    return F.timestamp_micros((since_epoch(ts) * 1000000).cast("bigint"))


def as_wall_clock(instant: Column | str) -> Column:
    """Zone-free reading of a UTC instant on a whole second."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return start + F.make_dt_interval(secs=F.unix_seconds(col(instant)).cast("decimal(18,6)"))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Second boundaries crossed; may be zero or negative."""
    return epoch_seconds(end) - epoch_seconds(start)


def minutes_between(start: Column | str, end: Column | str) -> Column:
    """Fractional minutes over whole seconds."""
    return seconds_between(start, end).cast("double") / F.lit(60.0)


def minute_boundaries(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries crossed."""
    return F.floor(epoch_seconds(end) / F.lit(60.0)) - F.floor(epoch_seconds(start) / F.lit(60.0))


def hour_part(ts: Column | str) -> Column:
    return F.hour(col(ts)).cast("bigint")


def dow_part(ts: Column | str) -> Column:
    """Day of week with Sunday = 0."""
    return (F.dayofweek(col(ts)) - 1).cast("bigint")
