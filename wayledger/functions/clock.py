"""Time-of-day text and trip-day expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wayledger.functions.text import js_trim

LAST_MINUTE = 23 * 60 + 59

# The accepted time grammars, each used in its own place.
GRAMMARS = {
    "page": "^([01][0-9]|2[0-3]):[0-5][0-9]$",
    "strict": "^([01][0-9]|2[0-3]):[0-5][0-9]$",
    "suggestion": "^([01]?[0-9]|2[0-3]):[0-5][0-9]$",
    "lax": "^[0-9]{1,2}:[0-9]{2}$",
    "export": "^[0-9]{1,2}:[0-9]{2}",
}
_TRIMMED = {"page", "strict"}


def valid_time(c: Column, grammar: str) -> Column:
    """Whether a text is a time in the named grammar; null is not."""
    text = js_trim(c) if grammar in _TRIMMED else c
    return F.coalesce(text.rlike(GRAMMARS[grammar]), F.lit(False))


def time_to_minutes(c: Column) -> Column:
    """Minutes since midnight of ``H:MM`` or ``HH:MM``; null when malformed."""
    hours = F.split_part(c, F.lit(":"), F.lit(1)).try_cast("int")
    minutes = F.split_part(c, F.lit(":"), F.lit(2)).try_cast("int")
    return F.when(valid_time(c, "lax"), hours * 60 + minutes)


def two_digits(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def minutes_to_time(c: Column) -> Column:
    """``HH:MM`` with the day's ends as limits."""
    within = F.greatest(F.lit(0), F.least(c, F.lit(LAST_MINUTE)))
    within = F.when(c.isNotNull(), within).cast("int")
    return F.concat(two_digits(F.floor(within / 60)), F.lit(":"), two_digits(within % 60))


def shift_time(c: Column, delta: Column) -> Column:
    return minutes_to_time(time_to_minutes(c) + delta)


def end_time(start: Column, duration: Column) -> Column:
    return shift_time(start, duration)


def overlap_minutes(duration: Column) -> Column:
    """Length used by the overlap rules: missing counts as zero."""
    return F.coalesce(duration, F.lit(0))


def event_minutes(duration: Column) -> Column:
    """Length used by calendar events: missing or not positive counts as an hour."""
    return F.when(duration > 0, duration).otherwise(F.lit(60))


def total_days(start: Column, end: Column) -> Column:
    return F.date_diff(end, start) + 1


def day_date(start: Column, day: Column) -> Column:
    return F.date_add(start, (day - 1).cast("int"))


def local_stamp(start: Column, day: Column, minutes: Column) -> Column:
    """Floating stamp ``yyyyMMddTHHmmss``; minutes beyond the day roll the date on."""
    rolled = F.date_add(start, (F.greatest(day, F.lit(1)) - 1 + F.floor(minutes / 1440)).cast("int"))
    rest = (minutes % 1440).cast("int")
    return F.concat(
        F.date_format(rolled, "yyyyMMdd"),
        F.lit("T"),
        two_digits(F.floor(rest / 60)),
        two_digits(rest % 60),
        F.lit("00"),
    )


def export_start_minutes(c: Column) -> Column:
    """Leading ``H:MM`` of a text in minutes, 09:00 when there is none."""
    hours = F.regexp_extract(c, "^([0-9]{1,2}):([0-9]{2})", 1).try_cast("int")
    minutes = F.regexp_extract(c, "^([0-9]{1,2}):([0-9]{2})", 2).try_cast("int")
    return F.coalesce(hours * 60 + minutes, F.lit(9 * 60))
