"""Identifiers on paper: format rules and declared-against-extracted checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if
from credence.functions.ids import digits_only, valid_registration_number, valid_tin
from credence.functions.numbers import round_to


def found(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, NULL when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def identifier_check(text: Column, tin: Column | None = None, number: Column | None = None) -> Column:
    """STRUCT(score, flags, tin, number); NULL score = nothing to judge.

    An extracted field value is preferred over a search of the text."""
    given = lambda c: F.nullif(c, F.lit("")) if c is not None else F.lit(None).cast("string")
    tin_value = F.coalesce(given(tin), found(text, V.TIN_STRICT), F.trim(found(text, V.TIN_LOOSE)))
    number_value = F.coalesce(given(number), F.trim(found(text, V.NUMBER_CAPTION)))
    mentioned = F.coalesce(text.rlike(r"(?i)\bTIN\b"), F.lit(False))
    bad_tin = tin_value.isNotNull() & ~valid_tin(tin_value)
    unread_tin = tin_value.isNull() & mentioned
    bad_number = number_value.isNotNull() & ~valid_registration_number(number_value, strict=False)
    penalty = (F.when(bad_tin, V.BAD_TIN_PENALTY).otherwise(0.0) + F.when(unread_tin, V.NO_TIN_PENALTY).otherwise(0.0)
               + F.when(bad_number, V.BAD_NUMBER_PENALTY).otherwise(0.0))
    nothing = tin_value.isNull() & ~mentioned & number_value.isNull()
    flags = compact(
        flag_if(bad_tin, F.concat(F.lit("Malformed TIN '"), tin_value,
                                  F.lit("' — does not match the 9-digit (NNN-NNN-NNN[-NNN]) format"))),
        flag_if(unread_tin, "Document references a TIN but no well-formed TIN could be read"),
        flag_if(bad_number, F.concat(F.lit("Malformed registration number '"), number_value, F.lit("'"))))
    score = F.when(~nothing, round_to(F.greatest(F.lit(0.0), F.lit(1.0) - penalty), 4))
    return F.struct(score.alias("score"), flags.alias("flags"), tin_value.alias("tin"), number_value.alias("number"))


def declared_against_extracted(vendors: DataFrame, extracted: DataFrame, column: str) -> DataFrame:
    """Whether the value read from a document equals the declared one, digits only."""
    declared = vendors.select("vendor_id", digits_only(F.col(column)).alias("_declared"))
    return declared.join(extracted, "vendor_id").select(
        "vendor_id", "doc_key", (F.col("_declared") == digits_only(F.col("value"))).alias("matches"))
