"""Media-time text and arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_time_ms(idx: Column, fps: Column) -> Column:
    return F.floor(idx * 1000.0 / F.greatest(fps, F.lit(1.0)))


def mmss_to_ms(text: Column) -> Column:
    """"MM:SS" to milliseconds; anything but exactly two integer parts is 0."""
    part = F.split(F.trim(text), ":")
    whole = lambda i: F.trim(F.get(part, F.lit(i))).try_cast("bigint")
    ms = (whole(0) * 60 + whole(1)) * 1000
    return F.when(F.size(part) == 2, F.coalesce(ms, F.lit(0))).otherwise(0).cast("bigint")


def clock_to_ms(text: Column) -> Column:
    """Base-60 parts ("H:MM:SS.s") or plain seconds to milliseconds; unreadable is 0."""
    parts = F.split(F.trim(text), ":")
    seconds = F.aggregate(
        parts, F.lit(0.0), lambda acc, p: acc * 60 + F.trim(p).try_cast("double")
    )
    return F.coalesce(F.floor(seconds * 1000 + 1e-6), F.lit(0)).cast("bigint")


def mmss_to_seconds(text: Column) -> Column:
    """"MM:SS" (seconds may be fractional) to seconds; unreadable is 0."""
    part = F.split(text, ":")
    number = lambda i: F.trim(F.get(part, F.lit(i))).try_cast("double")
    return F.when(F.size(part) == 2, F.coalesce(number(0) * 60 + number(1), F.lit(0.0))).otherwise(0.0)


def clean_clock(text: Column) -> Column:
    """Any clock-like text to "MM:SS": keeps the first two parts, drops decimals."""
    bare = F.regexp_replace(F.trim(text), "[^0-9:.]", "")
    part = F.split(bare, ":")
    two = F.size(part) > 1
    minutes = F.when(two, F.get(part, F.lit(0))).otherwise("00")
    seconds = F.split(F.when(two, F.get(part, F.lit(1))).otherwise(bare), "[.]")[0]
    pad = lambda c: F.when(F.length(c) < 2, F.lpad(c, 2, "0")).otherwise(c)
    return F.concat(pad(minutes), F.lit(":"), pad(seconds))


def hundredths(ms: Column) -> Column:
    """Milliseconds to hundredths of a second, rounded as printing ``ms / 1000`` with two places.

    A tie is decided by the binary value of the quotient: the sign of its rounding error.
    """
    s = ms / 1000.0
    big = s * 134217729.0
    high = big - (big - s)
    product = s * 1000.0
    error = (product - ms) + ((high * 1000.0 - product) + (s - high) * 1000.0)
    down = F.floor(ms / 10)
    up_on_tie = F.when(error > 0, 1).when(error < 0, 0).otherwise(down % 2)
    return down + F.when(ms % 10 == 5, up_on_tie).otherwise((ms % 10 > 5).cast("int"))


def clock_text(ms: Column) -> Column:
    """Milliseconds to "MM:SS.ss"."""
    minutes = F.floor(ms / 60000)
    part = hundredths(ms - minutes * 60000)
    return F.format_string("%02d:%02d.%02d", minutes, F.floor(part / 100), part % 100)


def duration_text(seconds: Column) -> Column:
    """Seconds to "M:SS" or "H:MM:SS"."""
    s = F.greatest(F.lit(0), F.floor(seconds)).cast("bigint")
    minutes = F.floor(s / 60)
    return F.when(
        minutes >= 60,
        F.format_string("%d:%02d:%02d", F.floor(minutes / 60), minutes % 60, s % 60),
    ).otherwise(F.format_string("%d:%02d", minutes, s % 60))
