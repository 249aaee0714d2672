"""Times of a service day and dates, as column expressions.

A service day may run past midnight, so a time is an integer number of seconds since the
start of the day and never a timestamp.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latest option time is 29:59:59.
MAX_HOUR, MAX_MINUTE, MAX_SECOND = 29, 59, 59


def time_to_secs(text: Column) -> Column:
    """`H:MM:SS` with any number of hour digits to seconds; blank or malformed gives null, as does
    a number of seconds that is no int."""
    trimmed = F.trim(text)
    hours = F.substring_index(trimmed, ":", 1)

    def pair(place: int) -> Column:
        return F.substring(trimmed, F.length(hours) + place, F.lit(2)).try_cast("long")

    secs = F.try_add(F.try_multiply(hours.try_cast("long"), F.lit(3600)), pair(2) * 60 + pair(5))
    return F.when(trimmed.rlike(r"^\d+:[0-5]\d:[0-5]\d(\r?\n|\r)?\z"), secs.try_cast("int"))


def secs_to_time(secs: Column) -> Column:
    """Seconds to `HH:MM:SS`."""
    return F.format_string("%02d:%02d:%02d", F.floor(secs / 3600), F.floor(secs % 3600 / 60), secs % 60)


def normalize_time(text: Column) -> Column:
    """Option text to `HH:MM:SS`: keep digits, pad with zeros on the right to six, take the
    last six, limit each pair. Meant for option fields; feed times go to `time_to_secs`."""
    ascii_digits = F.translate(text, "０１２３４５６７８９", "0123456789")
    digits = F.regexp_replace(ascii_digits, "[^0-9]", "")
    padded = F.concat(digits, F.repeat(F.lit("0"), F.greatest(F.lit(0), 6 - F.length(digits))))
    six = F.right(padded, F.lit(6))

    def pair(start: int, limit: int) -> Column:
        return F.lpad(F.least(F.lit(limit), F.substring(six, start, 2).cast("int")).cast("string"), 2, "0")

    return F.concat_ws(":", pair(1, MAX_HOUR), pair(3, MAX_MINUTE), pair(5, MAX_SECOND))


def time_digits(text: Column) -> Column:
    """`HH:MM:SS` to `HHMMSS`."""
    return F.translate(text, ":", "")


def date_compact(day: Column) -> Column:
    """Date to `yyyymmdd`."""
    return F.date_format(day, "yyyyMMdd")


def date_dashed(day: Column) -> Column:
    """Date to `yyyy-mm-dd`."""
    return F.date_format(day, "yyyy-MM-dd")


def parse_day(yyyymmdd: str) -> datetime.date | None:
    """Option text `yyyymmdd` to a date; an empty text means no filter."""
    return datetime.datetime.strptime(yyyymmdd, "%Y%m%d").date() if yyyymmdd else None


def parse_bound(text: str) -> int | None:
    """Option text `HHMMSS` or `HH:MM:SS` to seconds; an empty text means no bound."""
    digits = text.replace(":", "")
    if not digits:
        return None
    if len(digits) != 6 or not digits.isdigit():
        raise ValueError(f"not a HHMMSS time: {text!r}")
    return int(digits[:2]) * 3600 + int(digits[2:4]) * 60 + int(digits[4:])
