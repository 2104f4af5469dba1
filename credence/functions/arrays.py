"""Small helpers on ordered arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def compact(*items: Column) -> Column:
    """An array of the given values without the NULLs, order kept."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


def flag_if(condition: Column, token: str | Column) -> Column:
    """The token where the condition holds, else NULL."""
    return F.when(condition, token if isinstance(token, Column) else F.lit(token))


def union_in_order(*arrays: Column) -> Column:
    """Distinct union of arrays, first-seen order."""
    empty = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays]))


def first_match(array: Column, predicate) -> Column:
    """1-based index of the first element satisfying the predicate, 0 if none."""
    return F.coalesce(F.array_position(F.transform(array, predicate), F.lit(True)), F.lit(0)).cast("int")


def joined(array: Column, separator: str = "; ") -> Column:
    """Array to one string; an empty array gives the empty string."""
    return F.array_join(array, separator)


def literal_map(mapping: dict[str, str]) -> Column:
    """A constant MAP column."""
    parts: list[Column] = []
    for key, value in mapping.items():
        parts += [F.lit(key), F.lit(value)]
    return F.create_map(*parts)


def one_of(column: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Constant lookup by key with an optional default."""
    found = F.try_element_at(literal_map(mapping), column)
    return found if default is None else F.coalesce(found, default)
