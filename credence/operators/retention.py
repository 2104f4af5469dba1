"""Retention rules: contract of a policy and the sweep it declares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if


def default_policies(spark: SparkSession) -> DataFrame:
    """The fixed default policies (four rows)."""
    rows = F.array(*[F.struct(
        F.lit(k).alias("key"), F.lit(t).alias("data_type"), F.lit(days).cast("int").alias("retention_days"),
        F.lit(a).alias("archive_enabled"), F.lit(ad).cast("int").alias("archive_after_days"),
        F.lit(d).alias("deletion_enabled"), F.lit(dd).cast("int").alias("deletion_after_days"),
        F.lit(keep).alias("preserve_unread")) for k, t, days, a, ad, d, dd, keep in V.RETENTION])
    return spark.range(1).select(F.inline(rows))


def overlay(defaults: DataFrame, persisted: DataFrame) -> DataFrame:
    """Persisted policy values over the defaults, column by column."""
    columns = [c for c in defaults.columns if c not in ("key", "data_type")]
    own = persisted.select("key", *[F.col(c).alias(f"_{c}") for c in columns])
    joined = defaults.join(own, "key", "left")
    return joined.select("key", "data_type", *[F.coalesce(f"_{c}", c).alias(c) for c in columns])


def policy_faults() -> Column:
    days, archive, delete = F.col("retention_days"), F.col("archive_after_days"), F.col("deletion_after_days")
    return compact(
        flag_if(days.isNull() | (days < 1), "retention_days_below_one"),
        flag_if(F.col("archive_enabled") & archive.isNull(), "archive_days_missing"),
        flag_if(F.col("deletion_enabled") & delete.isNull(), "deletion_days_missing"),
        flag_if(archive > days, "archive_after_retention"),
        flag_if(delete > days, "deletion_after_retention"),
        flag_if(archive > delete, "archive_after_deletion"))


def sweep(rows: DataFrame, policies: DataFrame, now: str, on: str = "created_at",
          unread: Column | None = None) -> DataFrame:
    """Classify rows (with a data_type column) keep / archive / delete."""
    unread = F.lit(False) if unread is None else unread
    age = F.datediff(F.lit(now).cast("timestamp_ntz"), F.col(on))
    joined = rows.join(policies, "data_type", "left")
    protected = F.coalesce(F.col("preserve_unread") & unread, F.lit(False))
    verdict = (F.when(protected, "keep")
               .when(F.col("deletion_enabled") & (age >= F.col("deletion_after_days")), "delete")
               .when(F.col("archive_enabled") & (age >= F.col("archive_after_days")), "archive")
               .otherwise("keep"))
    return joined.select(*rows.columns, age.alias("age_days"), verdict.alias("verdict"))
