"""Global order: numbering, paging and natural sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence.session import durable


def number_rows(df: DataFrame, order: list[Column], name: str = "id") -> DataFrame:
    """1-based sequence over a global order without a one-task sort.

    The rows are range-sorted in parallel and written to the shared checkpoint
    folder with their partition-local position; the offsets come from one count
    per partition, a table as small as the number of partitions."""
    placed = durable(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.withColumn("_part", part).withColumn("_local", local)
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (placed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_offset") + F.col("_local") + 1)
            .drop("_at", "_part", "_local", "_offset"))


def page_of(df: DataFrame, order: list[Column], page: int, per_page: int = 25) -> DataFrame:
    """One page of a listing."""
    return df.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def page_after(df: DataFrame, sort_key: str, tie_key: str, last: tuple, per_page: int = 25) -> DataFrame:
    """Keyset paging for deep pages: descending by sort key, then tie key; the
    rows after ``last`` (sort value, tie value) are reached by a pushed filter."""
    key, tie = F.col(sort_key), F.col(tie_key)
    rest = (key < F.lit(last[0])) | ((key == F.lit(last[0])) & (tie < F.lit(last[1])))
    return df.where(rest).orderBy(key.desc(), tie.desc()).limit(per_page)


def natural_key(text: Column) -> Column:
    """Case-insensitive natural sort key: digit runs padded to 20 places."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(runs, lambda r: F.when(r.rlike(r"^\d+$"), F.lpad(r, 20, "0")).otherwise(r))
    return F.array_join(padded, "")
