"""Typed settings: overlay of defaults, checks, snapshot and its hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if
from credence.functions.hashing import settings_hash

WEIGHT_KEYS = ("risk_weight_text", "risk_weight_classification", "risk_weight_signature",
               "risk_weight_stamp", "risk_weight_tamper")


def schema_rows(spark: SparkSession) -> DataFrame:
    """The fixed settings schema (29 rows)."""
    rows = F.array(*[F.struct(
        F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(low).cast("double").alias("low"),
        F.lit(high).cast("double").alias("high"), F.lit(d).alias("default")) for k, t, low, high, d in V.SETTINGS])
    return spark.range(1).select(F.inline(rows))


def is_true(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


def stringify(value: Column) -> Column:
    """Six decimals with trailing zeros trimmed: 0.200000 -> 0.2."""
    fixed = F.format_string("%.6f", value)
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


def faults(raw: Column, kind: Column, low: Column, high: Column) -> Column:
    """Violations of one proposed value against its schema row."""
    number = raw.try_cast("double")
    whole = raw.rlike(r"^\s*[+-]?\d+\s*$")
    numeric = kind.isin("int", "float")
    return compact(
        flag_if((kind == "int") & ~whole, "not_an_integer"),
        flag_if((kind == "float") & number.isNull(), "not_a_number"),
        flag_if(numeric & (number < low), "below_minimum"),
        flag_if(numeric & (number > high), "above_maximum"),
        flag_if((kind == "string") & (F.length(raw) > 500), "too_long"))


def check_updates(updates: DataFrame, schema: DataFrame, value: str = "value") -> DataFrame:
    """Proposed updates with their violations; unknown keys are ignored."""
    known = updates.join(schema, "key")
    return known.withColumn("faults", faults(F.col(value), F.col("type"), F.col("low"), F.col("high")))


def check_weights(updates: DataFrame, by: str, value: str = "value") -> DataFrame:
    """Groups that propose all five risk weights: their sum may not pass 1.0001."""
    weights = updates.where(F.col("key").isin(*WEIGHT_KEYS))
    number = F.col(value).try_cast("double")
    return weights.groupBy(by).agg(
        F.count_distinct("key").alias("weights"), F.sum(F.coalesce(number, F.lit(0.0)).cast("decimal(20,6)")).alias("total")
    ).where(F.col("weights") == len(WEIGHT_KEYS)).select(
        by, F.col("total").cast("double").alias("total"), (F.col("total") > F.lit("1.0001").cast("decimal(20,6)")).alias("refused"))


def effective(schema: DataFrame, persisted: DataFrame, scopes: DataFrame, by: str) -> DataFrame:
    """Every setting of every scope: the persisted value, else the default."""
    defaults = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(d).alias("default"))
                         for k, t, _, _, d in V.SETTINGS])
    full = scopes.select(by, F.inline(defaults))
    return full.join(persisted.select(by, "key", "value"), [by, "key"], "left").select(
        by, "key", "type", F.coalesce("value", "default").alias("value"))


def snapshot(rows: DataFrame, by: str) -> DataFrame:
    """One settings map per scope with its hash; a map holds the fixed keys only."""
    packed = rows.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct(F.upper("key").alias("k"), F.col("value").alias("v"))))).alias("snapshot"))
    return packed.withColumn("settings_hash", settings_hash(F.col("snapshot")))


def runtime_faults(snapshot_map: Column) -> Column:
    """Range checks of the settings one attempt runs with."""
    found: list[Column] = []
    for key, low, high, nullable in V.RUNTIME_LIMITS:
        raw = F.coalesce(F.try_element_at(snapshot_map, F.lit(key)), F.try_element_at(snapshot_map, F.lit(key.upper())))
        number = raw.try_cast("double")
        unreadable = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        broken = unreadable | (number < low)
        if high is not None:
            broken = broken | (number > high)
        found.append(flag_if(raw.isNotNull() & broken, key))
    return compact(*found)


def threshold_in_force(admin: Column, environment: Column, calibrated: Column, default: float | None) -> Column:
    """Explicit value first, then the one training produced, then the default."""
    return F.coalesce(admin, environment, calibrated, F.lit(default).cast("double"))
