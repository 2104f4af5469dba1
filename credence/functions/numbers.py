"""Rounding that does not depend on binary noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Half-up rounding of the decimal value, so 0.285 -> 0.29 on every engine."""
    return F.round(value.cast("decimal(20,9)"), digits).cast("double")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, NULL for an empty whole."""
    return part / F.nullif(whole, F.lit(0))
