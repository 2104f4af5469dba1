"""Table changes as new DataFrames: upserts, inserts, decisions, seeding.

Nothing is written in place: the caller writes the result to a new version of
the table and switches over, so a lost job leaves the old version readable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by_key(rows: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Newest row per key by a combining aggregation."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*version)).alias("_row"))
    return picked.select(*keys, "_row.*")


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Latest wins; the later version of a key replaces the whole row."""
    return latest_by_key(base.unionByName(delta, allowMissingColumns=True), keys, version)


def upsert_keeping(base: DataFrame, delta: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """Full-row upsert except for ``keep`` columns: there a NULL in the delta
    means "not read this time" and leaves the stored value untouched."""
    fresh = delta.select(*keys, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in delta.columns if c not in keys])
    joined = base.join(fresh, keys, "full_outer")
    def merged(name: str) -> Column:
        new = F.col(f"_{name}")
        return (F.coalesce(new, F.col(name)) if name in keep
                else F.when(F.col("_new"), new).otherwise(F.col(name))).alias(name)
    return joined.select(*keys, *[merged(c) for c in base.columns if c not in keys])


def insert_or_ignore(base: DataFrame, delta: DataFrame, keys: list[str], earliest: list[str]) -> DataFrame:
    """Rows of the delta that may be inserted: one per key, the earliest, and
    only for keys the table does not hold yet."""
    others = [c for c in delta.columns if c not in keys]
    first = delta.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*earliest)).alias("_row"))
    return first.select(*keys, "_row.*").join(base.select(*keys), keys, "left_anti")


def rewrite_where(df: DataFrame, column: str, condition: Column, value: Column) -> DataFrame:
    """Change a column only where the condition holds."""
    return df.withColumn(column, F.when(condition, value).otherwise(F.col(column)))


def changed_columns(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Before/after of every column that differs (NULL-safe), one row each."""
    old = before.select(key, *[F.col(c).cast("string").alias(f"b_{c}") for c in columns])
    new = after.select(key, *[F.col(c).cast("string").alias(f"a_{c}") for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after"))
                      for c in columns])
    rows = old.join(new, key).select(key, F.inline(pairs))
    return rows.where(~F.col("before").eqNullSafe(F.col("after")))


ALLOWED_DECISIONS = ("approved", "resubmission_requested")


def decide(submissions: DataFrame, decisions: DataFrame) -> DataFrame:
    """Valid decisions applied to submissions that await review."""
    valid = decisions.where(F.col("decision").isin(*ALLOWED_DECISIONS))
    open_ones = submissions.where(F.col("status") == "pending_review")
    comment = F.nullif(F.trim("comments"), F.lit(""))
    return open_ones.drop("reviewed_by", "reviewed_at", "review_comments").join(valid, "submission_id").select(
        "submission_id", "vendor_id", F.col("decision").alias("status"), F.col("officer_id").alias("reviewed_by"),
        F.col("decided_at").alias("reviewed_at"), comment.alias("review_comments"), "composite_risk_score", "risk_level")


def vendor_changes(decided: DataFrame) -> DataFrame:
    """New vendor state; the latest decision of a vendor wins, no score reads 0."""
    newest = decided.groupBy("vendor_id").agg(
        F.max_by(F.struct("status", "composite_risk_score"), F.struct("reviewed_at", "submission_id")).alias("d"))
    return newest.select("vendor_id", F.when(F.col("d.status") == "approved", "approved").otherwise("rejected").alias("status"),
                         F.coalesce("d.composite_risk_score", F.lit(0.0)).alias("risk_score"))


def decision_events(decided: DataFrame) -> DataFrame:
    """The audit rows of the decisions."""
    return decided.select(
        F.col("reviewed_by").alias("user_id"), F.concat(F.lit("submission."), F.col("status")).alias("action"),
        F.lit("Submission").alias("entity_type"), F.col("submission_id").alias("entity_id"),
        F.struct("vendor_id", "composite_risk_score", "risk_level", F.col("review_comments").alias("comments")).alias("details"),
        F.col("reviewed_at").alias("created_at"))


def issuer_key(scope: Column, city: Column) -> Column:
    """'' for a national issuer, the city for a local one, NULL when unknown."""
    return F.when(scope == "national", "").when(scope == "lgu", F.nullif(F.trim(city), F.lit("")))


def seed_references(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Issuer references to create from approved documents.

    Needs document_type_id, type_name, issuer_scope, detected_city, stamp_box,
    document_id and approved_at."""
    keyed = candidates.where(F.col("issuer_scope").isNotNull() & (F.size("stamp_box") == 4)).withColumn(
        "city", issuer_key(F.col("issuer_scope"), F.col("detected_city"))).where(F.col("city").isNotNull())
    label = F.when(F.col("city") == "", F.col("type_name")).otherwise(F.concat_ws(" ", "city", "type_name"))
    rows = keyed.select("document_type_id", "city", label.alias("label"),
                        F.col("document_id").alias("seeded_from_document_id"), "approved_at")
    return insert_or_ignore(existing, rows, ["document_type_id", "city"], ["approved_at", "seeded_from_document_id"])
