"""Date functions over EXIF texts, offsets and shift amounts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def exif_time(stamp: Column, offset: Column) -> Column:
    """Epoch seconds of `yyyy:MM:dd HH:mm:ss` in the zone of offset; UTC if that isn't of the form +HH:MM; null if unreadable."""
    zone = F.when(F.char_length(offset) == 6, offset).otherwise("+00:00")
    return F.unix_micros(F.try_to_timestamp(F.concat(stamp, zone), F.lit("yyyy:MM:dd HH:mm:ssXXX"))) / F.lit(1e6)


def offset_seconds(offset: Column) -> Column:
    """Seconds east of UTC of +HH:MM, or null."""
    sign = F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1)
    part = lambda i: F.regexp_extract(offset, r"^[+-](\d\d):(\d\d)$", i)
    good = offset.rlike(r"^[+-]\d\d:\d\d$") & (part(1).cast("int") <= 14) & (part(2).cast("int") < 60)
    return F.when(good, sign * (part(1).try_cast("int") * 3600 + part(2).try_cast("int") * 60))


def wall_clock(seconds: Column, offset: Column) -> Column:
    """`yyyy:MM:dd HH:mm:ss` as a clock in the zone shows it (session zone UTC)."""
    return F.date_format(F.timestamp_seconds(F.floor(seconds + F.coalesce(offset_seconds(offset), F.lit(0)))), "yyyy:MM:dd HH:mm:ss")


def shift_amount(text: Column) -> Column:
    """Seconds of `n`, `H:MM` or `H:MM:SS` with an optional sign (n is seconds), or null."""
    form = r"^\s*([+-]?)(?:(\d+):([0-5]?\d)(?::([0-5]?\d))?|(\d+))\s*$"
    part = lambda i: F.coalesce(F.nullif(F.regexp_extract(text, form, i), F.lit("")).try_cast("long"), F.lit(0))
    seconds = part(2) * 3600 + part(3) * 60 + part(4) + part(5)
    return F.when(text.rlike(form), F.when(F.regexp_extract(text, form, 1) == "-", -seconds).otherwise(seconds))


def capture_sequence(start: float, interval: float, nth: Column) -> Column:
    """start + (nth - 1) * interval. nth: a place in the selection's order, from 1, as `duplicates.group_numbers` deals it."""
    return F.lit(float(start)) + F.lit(float(interval)) * (nth - 1)
