"""Notification fan-out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.numbers import round_to

#: Shares that the team is dealt into, so that one submission's notices come from
#: many tasks.
SHARES = 16


def fan_out(rows: DataFrame, users: DataFrame, to_vendor: dict[str, Column], to_staff: dict[str, Column]) -> DataFrame:
    """One notice to the vendor's user (when there is one) and one to each officer.
    Texts are composed once per submission; a team of any size joins them share by
    share."""
    own = rows.where(F.col("user_id").isNotNull()).select("user_id", *[c.alias(n) for n, c in to_vendor.items()], "submission_id")
    composed = rows.select("submission_id", *[c.alias(n) for n, c in to_staff.items()], F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("_share"))
    team = users.where(F.col("role").isin("admin", "compliance_officer")).select("user_id", F.pmod(F.xxhash64("user_id"), F.lit(SHARES)).cast("int").alias("_share"))
    return own.unionByName(composed.join(team, "_share").drop("_share"))


def processed(submissions: DataFrame, vendors: DataFrame, users: DataFrame) -> DataFrame:
    """Notices for processed submissions.

    Needs submission_id, vendor_id, composite_risk_score, risk_level and flags."""
    rows = submissions.join(vendors.select("vendor_id", "user_id", "company_name"), "vendor_id", "left")
    company = F.coalesce("company_name", F.lit("a vendor"))
    high, flagged = F.coalesce(F.col("risk_level") == "high", F.lit(False)), F.size("flags") > 0
    score = F.coalesce(round_to(F.col("composite_risk_score"), 0).cast("long"), F.lit(0)).cast("string")
    return fan_out(rows, users, {
        "type": F.lit("processing_complete"), "subject": F.lit("Processing complete"),
        "body": F.lit("Your submission has been processed and is awaiting review.")}, {
        "type": F.when(high, "high_risk_alert").when(flagged, "document_flagged").otherwise("general"),
        "subject": F.when(high, "High-risk submission").when(flagged, "Submission flagged").otherwise("Submission ready for review"),
        "body": F.when(high, F.concat(F.lit("High-risk submission detected (score: "), score, F.lit("/100) from "), company, F.lit(".")))
        .when(flagged, F.concat(F.lit("Submission from "), company, F.lit(" has been flagged: "),
                                F.array_join(F.slice("flags", 1, 3), "; "), F.lit(".")))
        .otherwise(F.concat(F.lit("Submission from "), company, F.lit(" is ready for review.")))})


def decided(decisions: DataFrame, vendors: DataFrame, users: DataFrame) -> DataFrame:
    """Notices for decided submissions (status, reviewed_by, review_comments)."""
    named = users.select(F.col("user_id").alias("reviewed_by"), F.col("name").alias("officer"))
    rows = (decisions.join(vendors.select("vendor_id", "user_id", "company_name"), "vendor_id", "left")
            .join(named, "reviewed_by", "left"))
    approved = F.col("status") == "approved"
    reason = F.trim(F.coalesce("review_comments", F.lit("")))
    tail = F.when(reason != "", F.concat(F.lit(" Reason: "), reason)).otherwise("")
    officer, company = F.coalesce("officer", F.lit("An officer")), F.coalesce("company_name", F.lit("a vendor"))
    return fan_out(rows, users, {
        "type": F.lit("decision_made"), "subject": F.when(approved, "Accreditation approved").otherwise("Resubmission requested"),
        "body": F.when(approved, "Your accreditation has been approved.").otherwise(F.concat(F.lit(
            "Your submission requires resubmission — please correct the flagged documents and submit again."), tail))}, {
        "type": F.lit("decision_made"), "subject": F.when(approved, "Submission approved").otherwise("Resubmission requested"),
        "body": F.when(approved, F.concat(officer, F.lit(" approved the submission from "), company, F.lit("."))).otherwise(
            F.concat(officer, F.lit(" requested resubmission from "), company, F.lit("."), tail))})


def received(submissions: DataFrame, vendors: DataFrame) -> DataFrame:
    """Receipt notice to the vendor's user."""
    rows = submissions.join(vendors.select("vendor_id", "user_id"), "vendor_id").where(F.col("user_id").isNotNull())
    return rows.select("user_id", F.lit("submission_received").alias("type"), F.lit("Submission received").alias("subject"),
                       F.lit("Your submission has been received and is being processed.").alias("body"), "submission_id")
