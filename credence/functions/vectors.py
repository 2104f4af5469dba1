"""Vector arithmetic on ARRAY<DOUBLE> with higher-order functions (JVM side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_total(F.transform(as_doubles(a), lambda x: x * x)))


def euclidean(a: Column, b: Column) -> Column:
    """Distance; NULL where the lengths differ."""
    squares = F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: (x - y) * (x - y))
    return F.when(F.size(a) == F.size(b), F.sqrt(_total(squares)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 when either vector is zero, NULL where lengths differ."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(scale == 0, F.lit(0.0)).otherwise(dot(a, b) / scale))


def unit(a: Column) -> Column:
    """The vector scaled to length 1; a zero vector is left as is."""
    length = norm(a)
    return F.when(length == 0, as_doubles(a)).otherwise(F.transform(as_doubles(a), lambda x: x / length))


def similarity_from_distance(distance: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + distance)


def calibrated_score(distance: Column, threshold: Column) -> Column:
    """1 at distance 0, one half at the threshold, 0 at twice the threshold."""
    raw = F.lit(1.0) - distance / (F.lit(2.0) * threshold)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    return F.when(distance.isNotNull() & (threshold > 0), F.round(bounded, 4))


def vector_fault(parsed: Column, raw: Column, expected_length: int | None = None) -> Column:
    """Why a JSON reference vector is refused, NULL when it is fine."""
    fault = (F.when(raw.isNull() | parsed.isNull() | (F.size(parsed) < 1), "not_a_non_empty_array")
             .when(F.exists(parsed, lambda x: x.isNull()), "not_numeric")
             .when(F.exists(parsed, lambda x: F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite"))
    if expected_length is not None:
        fault = fault.when(F.size(parsed) != expected_length, "wrong_length")
    return fault


def valid_box(box: Column) -> Column:
    """Four finite numbers forming a proper rectangle with non-negative origin."""
    finite = F.forall(box, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(
        (F.size(box) == 4) & finite & (F.get(box, 0) >= 0) & (F.get(box, 1) >= 0)
        & (F.get(box, 2) > F.get(box, 0)) & (F.get(box, 3) > F.get(box, 1)), F.lit(False))


def clip_box(box: Column, width: Column, height: Column) -> Column:
    """Box truncated to non-negative integers, ordered and clipped to the page;
    NULL when nothing is left."""
    corner = F.transform(box, lambda v: F.greatest(F.lit(0), v.cast("int")))
    x1, y1, x2, y2 = (F.get(corner, i) for i in range(4))
    left, right = F.least(x1, x2, width), F.least(F.greatest(x1, x2), width)
    top, bottom = F.least(y1, y2, height), F.least(F.greatest(y1, y2), height)
    return F.when((F.size(box) == 4) & (right > left) & (bottom > top), F.array(left, top, right, bottom))
