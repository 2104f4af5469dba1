"""Portable hashing: md5 based, so any SQL engine gives the same picks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash32(*parts: Column | str) -> Column:
    """First 32 bits of md5 over the '|'-joined parts, as a non-negative LONG."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def sorted_json(columns: dict[str, Column]) -> Column:
    """Compact JSON object with keys in alphabetical order."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]),
                     {"ignoreNullFields": "false"})


def record_hash(columns: dict[str, Column]) -> Column:
    """Order-independent SHA-1 of a record's fields."""
    return F.sha1(sorted_json(columns))


def settings_hash(snapshot: Column) -> Column:
    """SHA-256 of a MAP<STRING,STRING> settings snapshot, keys sorted.

    Values are hashed in their stored string form, so the result does not depend
    on how an engine prints numbers."""
    entries = F.array_sort(F.map_entries(snapshot))
    return F.sha2(F.to_json(F.map_from_entries(entries)), 256)
