"""Domain views derived from the given tables.

Every view is a lazy projection, grouping or join over the Parquet tables, so
its work grows with them. ``plans/domain_sql.py`` states the same views in SQL."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if, union_in_order
from credence.functions.vectors import calibrated_score
from credence.operators.risk import missing_component_flags, risk_band, score_document


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of the data folder."""
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def document_types(spark: SparkSession) -> DataFrame:
    """The fixed list of document types (nine rows, hence broadcast by users)."""
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("document_type_id"), F.lit(n).alias("type_name"),
                              F.lit(c).alias("type_code"), F.lit(s).cast("string").alias("issuer_scope"))
                     for i, n, c, s in V.DOCUMENT_TYPES])
    return spark.range(1).select(F.inline(rows))


def days_after(start: str, days: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))


def whole(column: str) -> Column:
    """Integer part of a DOUBLE column."""
    return F.floor(F.col(column)).cast("long")


def hundredths(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("long")


def attempt_order() -> Column:
    """Date, part and supplier of an attempt as one number, which an aggregation can
    hold in place: 17, 11 and 10 digits."""
    digits = lambda column, many, power: column.cast(f"decimal({many},0)") * F.lit(str(10**power)).cast(f"decimal({power + 1},0)")
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', CAST(l_shipdate AS TIMESTAMP_NTZ))")
    return (digits(micros, 17, 21) + digits(F.col("l_partkey"), 11, 10) + F.col("l_suppkey").cast("decimal(10,0)")).cast("decimal(38,0)")


def attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per processing attempt of a document (line items repeat a
    document's key; each repeat is a retry)."""
    return described(table(spark, folder, "lineitem").withColumn("attempt_order", attempt_order()))


def described(items: DataFrame) -> DataFrame:
    """What an attempt says of its document, from the columns of a line item."""
    qty, price, disc, tax = whole("l_quantity"), whole("l_extendedprice"), hundredths("l_discount"), hundredths("l_tax")
    part, supp, ret = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_returnflag")
    kinds = F.array(*[F.lit(k).cast("long") for k in (1, 4, 5, 1, 5, 6, 9, None)])
    endings = F.array(*[F.lit(e) for e in ("pdf", "png", "jpg")])
    mimes = F.array(*[F.lit(m) for m in ("application/pdf", "image/png", "image/jpeg")])
    distance = F.when(~((ret == "N") & (part % 2 == 0)), qty / 20.0)
    return items.select(
        *[c for c in items.columns if not c.startswith("l_")],
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("document_id"),
        F.col("l_orderkey").alias("submission_id"),
        F.get(kinds, (part % 8).cast("int")).alias("document_type_id"),
        F.get(endings, (price % 3).cast("int")).alias("extension"),
        F.get(mimes, (price % 3).cast("int")).alias("mime_type"),
        (price * 40).alias("file_size_bytes"),
        F.when(qty % 10 == 0, "failed").when((qty % 10 == 1) & (F.col("l_linestatus") == "O"), "verifying")
        .otherwise("completed").alias("processing_status"),
        F.when(supp % 11 != 0, (100 - tax * 5) / 100.0).alias("text_score"),
        F.when(part % 13 != 0, (50 + disc * 5) / 100.0).alias("classification_confidence"),
        F.when(part % 13 != 0, F.when(disc == 10, 0.05).otherwise((90 + disc) / 100.0)).alias("classification_authenticity"),
        distance.alias("signature_distance"),
        calibrated_score(distance, F.lit(V.SIGNATURE_DISTANCE)).alias("signature_score"),
        F.when(~((ret == "A") & (supp % 3 == 0)), (700 + part % 300) / 1000.0).alias("stamp_score"),
        F.when(price % 17 != 0, (1000 - price % 600) / 1000.0).alias("tamper_authenticity"),
        F.when(price % 17 != 0, F.when(price % 23 == 0, 0.85).otherwise((price % 70) / 100.0)).alias("tamper_confidence"),
        F.when(price % 29 == 0, F.concat(F.lit("ELA: anomalous compression region at ["),
                                         (price % 16 * 16).cast("string"), F.lit("]"))).alias("region_flag"),
        (disc == 10).alias("is_fake"),
        F.col("l_shipdate").alias("completed_at"),
    )


def documents(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Each document with its latest attempt; with ``of`` (submission_id) only those of
    these submissions, whose attempts alone are put in order.

    Line items are shuffled once, by submission: what is grouped or joined by submission
    afterwards moves no row again. Attempts are ranked where they lie, and the values of
    the first rank are picked by a hash aggregation over numbers; columns that a query
    doesn't ask for are pruned, and texts are derived afterwards."""
    numbers = ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    letters = ("l_returnflag", "l_linestatus")
    newest = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*[F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey")])
    items = table(spark, folder, "lineitem")
    by_order = items.repartition("l_orderkey") if of is None else items.join(
        of.select(F.col("submission_id").alias("l_orderkey")).hint("shuffle_hash"), "l_orderkey", "left_semi")
    ranked = by_order.withColumn("_rank", F.row_number().over(newest))
    first = lambda c: F.max(F.when(F.col("_rank") == 1, c))
    latest = ranked.groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("attempts"), *[first(F.col(c)).alias(c) for c in numbers], *[first(F.ascii(c)).alias(c) for c in letters])
    spelled = latest.withColumns({c: F.char(c) for c in letters})
    return described(spelled).withColumn(
        "original_filename", F.concat(F.lit("doc-"), F.col("document_id"), F.lit("."), F.col("extension")))


def component_columns() -> dict[str, Column]:
    return {
        "text": F.col("text_score"),
        "classification": F.coalesce("classification_authenticity", "classification_confidence"),
        "signature": F.col("signature_score"),
        "stamp": F.col("stamp_score"),
        "tamper": F.col("tamper_authenticity"),
    }


def results(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """Documents that have a validation result, with risk and ordered flags."""
    return _validated(documents(spark, folder, of).where(has_result()))


def has_result() -> Column:
    return F.col("processing_status") != "verifying"


def judged(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    """All documents with the columns of their results, from one pass over the
    attempts; ``scored`` tells whether a document has a result, and without one its
    score and flags are NULL."""
    rows = _validated(documents(spark, folder, of)).withColumn("scored", has_result())
    return rows.withColumns({c: F.when(F.col("scored"), F.col(c)) for c in ("document_risk_score", "flags")})


def _validated(docs: DataFrame) -> DataFrame:
    parts = component_columns()
    scored = docs.withColumn("risk", score_document(parts, F.col("tamper_confidence")))
    raised = compact(
        flag_if(F.col("is_fake") & F.col("classification_confidence").isNotNull(), "classified_as_fake"),
        flag_if(F.col("classification_confidence") < 0.70, "low_classification_confidence"),
        flag_if(F.col("text_score") < V.TEXT_PASS, "missing_required_fields:tin,date_issued"),
        flag_if(F.col("signature_distance") > V.SIGNATURE_DISTANCE, "signature_mismatch"),
        flag_if(F.col("signature_distance").isNull(), "no_signature_reference"),
        flag_if(F.col("stamp_score") < V.STAMP_SIMILARITY, "stamp_mismatch"),
        flag_if(F.col("stamp_score").isNull(), "unreferenced_logo"),
        F.col("region_flag"),
        flag_if(F.col("risk.hard_override"), V.TAMPER_FLAG),
    )
    failed = compact(flag_if(F.col("processing_status") == "failed", "processing_failed"))
    return scored.select(
        "*", F.col("risk.score").alias("document_risk_score"),
        union_in_order(raised, missing_component_flags(parts), failed).alias("flags"))


def submission_scores(spark: SparkSession, folder: str, of: DataFrame | None = None) -> DataFrame:
    return results(spark, folder, of).groupBy("submission_id").agg(
        F.max("document_risk_score").alias("composite_risk_score"))


def submission_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Submissions as intake knows them, before any score."""
    orders = table(spark, folder, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    decided = status == "F"
    return orders.select(
        key.alias("submission_id"), F.col("o_custkey").alias("vendor_id"),
        F.when(status == "P", "pending_review").when(status == "O", "processing")
        .when(key % 3 != 0, "approved").otherwise("resubmission_requested").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(decided, -(F.col("o_custkey") % 25) - 1).alias("reviewed_by"),
        F.when(decided, F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("reviewed_at"),
        F.when(decided & (key % 3 == 0), F.concat(F.lit("Priority "), F.col("o_orderpriority"))).alias("review_comments"),
    )


def submissions(spark: SparkSession, folder: str, *status: str) -> DataFrame:
    """Submissions with the composite score once processing has ended: all, or those in
    a ``status``."""
    rows = submission_rows(spark, folder)
    if not status:
        return rated(rows, submission_scores(spark, folder))
    rows = rows.where(F.col("status").isin(*status))
    return rated(rows, submission_scores(spark, folder, rows))


def rated(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Submissions with what ``scores`` says of their documents, and their risk band."""
    scored = rows.join(scores, "submission_id", "left")
    score = F.when(F.col("status") != "processing", F.col("composite_risk_score"))
    return scored.withColumn("composite_risk_score", score).withColumn("risk_level", risk_band(score))


def officers(spark: SparkSession, folder: str) -> DataFrame:
    """Review staff: one per nation (25 rows at every scale)."""
    return table(spark, folder, "nation").select(
        (-F.col("n_nationkey") - 1).cast("long").alias("user_id"),
        F.concat(F.lit("Officer "), F.col("n_name")).alias("name"),
        F.concat(F.lower("n_name"), F.lit("@office.test")).alias("email"),
        F.when(F.col("n_regionkey") == 0, "admin").otherwise("compliance_officer").alias("role"),
        F.lit(True).alias("is_active"),
        days_after("2022-01-01", F.col("n_nationkey")).alias("created_at"),
        days_after("2022-01-02", F.col("n_nationkey")).alias("email_verified_at"),
        F.lit(None).cast("timestamp_ntz").alias("signature_enrolled_at"),
    )


def users(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    vendors_side = table(spark, folder, "customer").select(
        key.alias("user_id"), F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@vendor.test")).alias("email"),
        F.lit("vendor").alias("role"), (key % 10 != 0).alias("is_active"),
        days_after("2023-01-01", key % 365).alias("created_at"),
        F.when(key % 4 != 0, days_after("2023-01-02", key % 365)).alias("email_verified_at"),
        F.when(key % 3 != 0, days_after("2023-01-03", key % 365)).alias("signature_enrolled_at"),
    )
    return vendors_side.unionByName(officers(spark, folder))


def vendors(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    nations = table(spark, folder, "nation")
    customers = table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    states = F.array(*[F.lit(s) for s in ("pending", "under_review", "approved", "rejected")])
    entity = F.array(*[F.lit(s) for s in ("sole_proprietorship", "partnership", "corporation")])
    return customers.select(
        key.alias("vendor_id"), key.alias("user_id"),
        F.concat(F.initcap("c_mktsegment"), F.lit(" Works "), key).alias("company_name"),
        F.when(key % 7 == 0, None).when(key % 5 == 0, "").otherwise(F.concat(F.lit("REG-"), key + 100000)).alias("registration_number"),
        F.when(key % 2 == 0, F.concat(F.lit("DTI "), key + 2000)).otherwise("").alias("dti_registration_number"),
        F.when(key % 3 == 0, F.concat(F.lit("CS"), key + 2000000)).alias("sec_registration_number"),
        F.concat_ws("-", F.lpad((key % 1000).cast("string"), 3, "0"), F.lit("118"),
                    F.when(key % 9 == 0, "90").otherwise("902")).alias("tin"),
        F.get(entity, (key % 3).cast("int")).alias("business_entity_type"),
        F.get(states, (F.col("c_nationkey") % 4).cast("int")).alias("status"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 100).cast("double")).alias("risk_score"),
        F.concat(key, F.lit(" Market St")).alias("business_street"),
        F.when(key % 6 == 0, "").otherwise(F.concat(F.lit("Barangay "), key % 40)).alias("business_barangay"),
        F.initcap("n_name").alias("business_city"),
        F.when(key % 4 == 0, None).otherwise("Metro").alias("business_province"),
        F.lpad((key % 9999).cast("string"), 4, "0").alias("business_postal_code"),
        days_after("2023-01-01", key % 365).alias("registered_at"),
    )


def audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, folder, "events").select(
        key.alias("log_id"),
        F.when(key % 50 == 0, None).when(key % 41 == 0, F.col("user_id") + 1000000000)
        .otherwise(F.col("user_id")).alias("user_id"),
        F.when(kind == "view", "auth.login").when(kind == "click", "user.role_changed")
        .when(kind == "signup", "user.created").when(kind == "purchase", "submission.approved")
        .otherwise("ml_model.missing").alias("action"),
        F.when(kind == "view", None).when(kind == "purchase", "Domain\\Review\\Submission")
        .when(kind == "error", "Domain\\Models\\MlModel").otherwise("Domain\\Accounts\\User").alias("entity_type"),
        F.when(kind != "view", F.floor("value").cast("long")).alias("entity_id"),
        F.col("props").alias("details"),
        F.concat(F.lit("10.0."), F.col("user_id") % 256, F.lit("."), key % 250).alias("ip_address"),
        F.col("ts").alias("created_at"),
    )


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    kind, key = F.col("event_type"), F.col("event_id")
    return table(spark, folder, "events").select(
        key.alias("notification_id"), F.col("user_id"),
        F.when(kind == "error", "high_risk_alert").when(kind == "purchase", "decision_made")
        .otherwise("general").alias("type"),
        (F.col("value") >= 20).alias("is_read"), F.col("ts").alias("created_at"))
