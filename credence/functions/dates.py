"""Timestamps as they appear in file metadata and on certificates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted layouts in order, the width each one reads, its shape.
PROVENANCE_LAYOUTS = (
    ("y:M:d H:m:s", 19, r"^\d{4}:\d{1,2}:\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("y-M-d'T'H:m:s", 19, r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$"),
    ("y-M-d H:m:s", 19, r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("yyyyMMddHHmmss", 14, r"^\d{14}$"),
    ("y-M-d", 10, r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("y:M:d", 10, r"^\d{4}:\d{1,2}:\d{1,2}$"),
)


def parse_provenance(value: Column) -> Column:
    """First layout that reads the value wins; longer text is cut to the layout's
    width, which drops any trailing zone. Unreadable text gives NULL. The shape
    test comes first because a failed parse costs an exception per row."""
    text = F.trim(F.regexp_replace(F.trim(value), "^[D:]+", ""))
    readings = []
    for layout, width, shape in PROVENANCE_LAYOUTS:
        part = F.substring(text, 1, width)
        readings.append(F.when(part.rlike(shape), F.try_to_timestamp(part, F.lit(layout)).cast("timestamp_ntz")))
    return F.coalesce(*readings)


def whole_hours_between(earlier: Column, later: Column) -> Column:
    """Whole hours from earlier to later, truncated toward zero."""
    seconds = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
    return (seconds / 3600).cast("long")


def stamp(ts: Column) -> Column:
    """Plain text form used in result columns."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def ordinal_day(day: Column) -> Column:
    """1 -> 1st, 12 -> 12th, 23 -> 23rd."""
    suffix = (
        F.when((day % 100).between(11, 13), "th")
        .when(day % 10 == 1, "st").when(day % 10 == 2, "nd").when(day % 10 == 3, "rd")
        .otherwise("th")
    )
    return F.concat(day.cast("string"), suffix)
