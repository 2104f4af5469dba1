"""Running totals and ranks that spread one large key over many tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], bucket: str, order: list[str], value: Column, name: str,
                inclusive: bool = True) -> DataFrame:
    """Running sum of ``value`` within keys in the given order.

    ``bucket`` must be a coarse leading part of the order (a day, a hash prefix).
    Totals per (key, bucket) give each bucket its start; only the rows of one
    bucket are ordered together, so a key that holds most of the data is shared
    by as many tasks as it has buckets."""
    tagged = rows.withColumn("_value", value)
    sizes = tagged.groupBy(*keys, bucket).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, bucket, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    placed = tagged.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return (placed.join(starts, [*keys, bucket]).withColumn(name, F.col("_start") + F.col("_inside"))
            .drop("_value", "_start", "_inside"))
