"""Identifier rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# 9 base digits, or 9 with a branch code of 3, 4 or 5 digits.
TIN_DIGITS = (9, 12, 13, 14)
MIN_REGISTRATION_DIGITS = 5


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def valid_tin(text: Column) -> Column:
    return F.length(digits_only(text)).isin(*TIN_DIGITS)


def valid_registration_number(text: Column, strict: bool = True) -> Column:
    """At least five digits; the strict form also limits the alphabet."""
    enough = F.length(digits_only(text)) >= MIN_REGISTRATION_DIGITS
    return enough & F.trim(text).rlike(r"^[A-Za-z0-9\-/]+$") if strict else enough
