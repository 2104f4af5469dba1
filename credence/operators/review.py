"""Officer screens: summaries, queues, logs, KPIs and drill-down rows.

Inputs are the domain frames; nothing here knows where they come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact
from credence.functions.dates import whole_hours_between
from credence.functions.formatting import (
    activity_icon, action_headline, byte_size, first_truthy, flag_category, humanise_flag, joined_address,
    preview_kind, submission_reference)
from credence.functions.numbers import ratio, round_to
from credence.operators.ordering import natural_key
from credence.operators.risk import risk_band
from credence.session import durable

PENDING = "pending_review"
DECIDED = ("approved", "resubmission_requested")
PROCESSED = (PENDING, *DECIDED)


def flag_rows(results: DataFrame) -> DataFrame:
    """One row per raised flag with its position."""
    return raised_flags(results, "submission_id", "document_id")


def raised_flags(results: DataFrame, *columns: str) -> DataFrame:
    """``columns``, pos and flag of every raised flag. Rows without one are dropped after
    the explosion: a test before it would derive all flags a second time."""
    return results.select(*columns, F.posexplode_outer("flags").alias("pos", "flag")).where(F.col("pos").isNotNull())


def typed_documents(documents: DataFrame, types: DataFrame) -> DataFrame:
    """Documents with their type name; unknown types read 'Unassigned'."""
    return (documents.join(types, "document_type_id", "left")
            .withColumn("type_name", F.coalesce("type_name", F.lit("Unassigned"))))


def distinct_in_order(rows: DataFrame, keys: list[str], value: str, order: list[str], name: str) -> DataFrame:
    """Per key the distinct values in first-seen order (one or two whole numbers, the
    second of at most ten digits).

    Duplicates are dropped before any list is built, so a list is only as long
    as its set of distinct values, however many rows a key has."""
    place = F.col(order[0]) if len(order) == 1 else (
        F.col(order[0]).cast("decimal(20,0)") * F.lit(10**10).cast("decimal(11,0)") + F.col(order[1]).cast("decimal(10,0)")).cast("decimal(38,0)")
    first = rows.groupBy(*keys, value).agg(F.min(place).alias("_first"))
    listed = F.array_sort(F.collect_list(F.struct("_first", value)))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x[value]).alias(name))


def digests(judged: DataFrame, types: DataFrame) -> DataFrame:
    """What the documents of a submission say together: their types and humanised
    flags in first-seen order, their number and their highest score.

    judged: submission_id, document_id (below 2^43), document_type_id, and of the result,
    if there is one, flags (less than 2^20) and document_risk_score. Types and phrases are counted as entries of one
    frame, so documents are passed over once; repeats are dropped before any list is
    built. Documents that lie by submission are not shuffled."""
    entry = lambda kind, text, pos: F.struct(F.lit(kind).alias("kind"), text.alias("text"), pos.alias("pos"))
    raised = F.transform(F.coalesce("flags", F.array().cast("array<string>")), lambda flag, i: entry("flag", flag, i))
    known = typed_documents(judged, types)
    entries = known.select("submission_id", "document_id", "document_risk_score", F.inline_outer(F.concat(F.array(entry("type", F.col("type_name"), F.lit(0))), raised)))
    place = F.col("document_id") * 2**20 + F.col("pos")  # a number, so that hash aggregation holds it in place
    text = F.when(F.col("kind") == "flag", humanise_flag(F.col("text"))).otherwise(F.col("text"))
    first = entries.select("submission_id", "kind", text.alias("text"), "document_risk_score", place.alias("_place")).groupBy("submission_id", "kind", "text").agg(
        F.min("_place").alias("_first"), F.count("*").alias("_n"), F.max("document_risk_score").alias("_top"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("_first", "text")))), lambda x: x["text"])
    return first.groupBy("submission_id").agg(
        listed("type").alias("_types"), listed("flag").alias("_flags"),
        F.sum(F.when(F.col("kind") == "type", F.col("_n"))).alias("documents_count"), F.max("_top").alias("composite_risk_score"))


def summary_rows(submissions: DataFrame, vendors: DataFrame, users: DataFrame) -> DataFrame:
    """The compact queue row of each submission; submissions hold the columns that
    ``digests`` gives of their documents."""
    names = users.select("user_id", F.col("name").alias("contact"))
    reviewers = users.select(F.col("user_id").alias("reviewed_by"), F.col("name").alias("reviewer"))
    companies = vendors.select("vendor_id", "user_id", "company_name")
    status = F.col("status")
    return (
        submissions.join(companies, "vendor_id", "left").join(names, "user_id", "left")
        .join(reviewers, "reviewed_by", "left")
        .select(
            "submission_id", submission_reference(F.col("submission_id")).alias("ref"),
            F.coalesce("company_name", F.lit("—")).alias("company"),
            F.coalesce("contact", F.lit("—")).alias("vendor"), "vendor_id",
            F.coalesce(F.array_join("_types", ", "), F.lit("—")).alias("document_type"),
            F.coalesce("documents_count", F.lit(0)).alias("documents_count"),
            F.col("created_at").alias("submitted_at"),
            F.coalesce("_flags", F.array().cast("array<string>")).alias("flags"),
            round_to(F.col("composite_risk_score"), 0).cast("long").alias("risk_score"),
            "composite_risk_score", "risk_level", "status",
            F.when(status.isin(*DECIDED), status).alias("decision"),
            F.col("reviewer").alias("reviewed_by"), "reviewed_at", "review_comments"))


def contains_term(term: str, *columns: str) -> Column:
    """Literal, case-blind search over the joined display columns; a term's
    wildcards have no meaning here. An empty term matches everything."""
    needle = term.strip().lower()
    if not needle:
        return F.lit(True)
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns]))
    return haystack.contains(needle)


SEARCHED = ("ref", "company", "vendor", "document_type")


def pending(summary: DataFrame, risk: str = "all", term: str = "") -> DataFrame:
    rows = summary.where(F.col("status") == PENDING)
    if risk != "all":
        rows = rows.where(F.col("risk_level") == risk)
    return rows.where(contains_term(term, *SEARCHED))


def archived(summary: DataFrame, decision: str = "all", risk: str = "all", term: str = "") -> DataFrame:
    rows = summary.where(F.col("status").isin(*DECIDED))
    if decision != "all":
        rows = rows.where(F.col("status") == decision)
    if risk != "all":
        rows = rows.where(F.col("risk_level") == risk)
    return rows.where(contains_term(term, *SEARCHED))


def by_urgency() -> list[Column]:
    return [F.col("composite_risk_score").desc_nulls_last(), F.col("submission_id")]


def dashboard_kpis(summary: DataFrame, now: Column) -> DataFrame:
    """One row, one pass: queue sizes and the approval rate."""
    waiting = F.col("status") == PENDING
    flagged = waiting & (F.size("flags") > 0) & (F.col("submitted_at") >= F.date_trunc("day", now))
    decided = F.count_if(F.col("status").isin(*DECIDED))
    approved = F.count_if(F.col("status") == "approved")
    rate = F.concat(F.round(ratio(approved * 100, decided).cast("decimal(20,6)"), 0).cast("long").cast("string"), F.lit("%"))
    return summary.agg(
        F.count_if(waiting).alias("pending"), F.count_if(flagged).alias("flagged_today"),
        F.count_if(waiting & (F.col("risk_level") == "high")).alias("high_risk"),
        F.coalesce(rate, F.lit("—")).alias("approval_rate"))


def status_kpis(submissions: DataFrame, by: str | None = None) -> DataFrame:
    """Counts by state, in total or per group."""
    status = F.col("status")
    grouped = submissions.groupBy(by) if by else submissions.groupBy()
    return grouped.agg(
        F.count("*").alias("total"), F.count_if(status.isin("processing", PENDING)).alias("in_progress"),
        F.count_if(status == "approved").alias("approved"),
        F.count_if(status == "resubmission_requested").alias("resubmission_requested"))


def activity_feed(logs: DataFrame, users: DataFrame, limit: int = 6) -> DataFrame:
    """The newest audit events as sentences. The top-k runs before the join."""
    newest = logs.orderBy(F.col("created_at").desc(), F.col("log_id").desc()).limit(limit)
    named = newest.join(users.select("user_id", "name"), "user_id", "left")
    text = F.concat(action_headline(F.col("action")), F.lit(" — "), F.coalesce("name", F.lit("System")))
    return named.select("log_id", activity_icon(F.col("action")).alias("icon"), text.alias("text"), "created_at")


def risk_log(summary: DataFrame, results: DataFrame) -> DataFrame:
    """Every flag of every processed submission."""
    processed = summary.where(F.col("status").isin(*PROCESSED)).select(
        "submission_id", "ref", "vendor", "company", "document_type", "risk_level", "submitted_at")
    raised = raised_flags(results, "submission_id", "document_id", "original_filename", "completed_at")
    return raised.join(processed, "submission_id").select(
        flag_category(F.col("flag")).alias("type"),
        F.when(F.col("risk_level") == "high", "high").otherwise("medium").alias("severity"),
        F.col("flag").alias("title"), F.col("original_filename").alias("detail"),
        F.coalesce("completed_at", "submitted_at").alias("raised_at"),
        "submission_id", "document_id", "pos", "ref", "vendor", "company", "document_type")


def log_order() -> list[Column]:
    return [F.col("raised_at").desc(), F.col("submission_id"), F.col("document_id"), F.col("pos")]


def filter_log(log: DataFrame, kind: str = "all", severity: str = "all", hours: int | None = None,
               now: Column | None = None, term: str = "") -> DataFrame:
    rows = log
    if kind != "all":
        rows = rows.where(F.col("type") == kind)
    if severity != "all":
        rows = rows.where(F.col("severity") == severity)
    if hours is not None:
        rows = rows.where(F.abs(whole_hours_between(F.col("raised_at"), now)) <= hours)
    return rows.where(contains_term(term, "ref", "company", "vendor", "title", "document_type"))


def vendor_directory(vendors: DataFrame, users: DataFrame, submissions: DataFrame,
                     status: str = "all", term: str = "") -> DataFrame:
    counted = submissions.groupBy("vendor_id").agg(F.count("*").alias("submissions_count"))
    people = users.select("user_id", F.col("name").alias("contact"),
                          F.col("signature_enrolled_at").isNotNull().alias("enrolled"))
    rows = vendors if status == "all" else vendors.where(F.col("status") == status)
    joined = rows.join(people, "user_id", "left").join(counted, "vendor_id", "left").select(
        "vendor_id", F.col("company_name").alias("company"), F.coalesce("contact", F.lit("—")).alias("contact"),
        F.coalesce("registration_number", F.lit("")).alias("registration_number"), "status", "registered_at",
        F.coalesce("submissions_count", F.lit(0)).alias("submissions_count"),
        F.coalesce("enrolled", F.lit(False)).alias("enrolled"))
    return joined.where(contains_term(term, "company", "contact", "registration_number"))


def vendor_profiles(vendors: DataFrame, users: DataFrame, submissions: DataFrame) -> DataFrame:
    """One row per vendor: falsy fallbacks, counts, last submission, risk band."""
    activity = submissions.groupBy("vendor_id").agg(
        F.count("*").alias("submissions_count"), F.max("created_at").alias("last_submission_at"),
        F.max_by("submission_id", F.struct("created_at", "submission_id")).alias("last_submission_id"))
    people = users.select("user_id", F.col("name").alias("contact"), "signature_enrolled_at")
    address = joined_address(*[F.col(c) for c in (
        "business_street", "business_barangay", "business_city", "business_province", "business_postal_code")])
    return vendors.join(people, "user_id", "left").join(activity, "vendor_id", "left").select(
        "vendor_id", F.col("company_name").alias("company"), F.coalesce("contact", F.lit("—")).alias("contact"),
        first_truthy(F.col("registration_number"), F.col("dti_registration_number"),
                     F.col("sec_registration_number")).alias("registration_number"),
        address.alias("address"), "status", "risk_score", risk_band(F.col("risk_score")).alias("risk_level"),
        F.coalesce("submissions_count", F.lit(0)).alias("submissions_count"),
        "last_submission_at", "last_submission_id",
        F.col("signature_enrolled_at").isNotNull().alias("enrolled"))


def risk_driver(flags: Column) -> Column:
    """Why a submission scored as it did, in one sentence."""
    lead = F.concat(F.lit("Driven by: "), F.array_join(F.slice(flags, 1, 2), "; "),
                    F.when(F.size(flags) > 2, "…").otherwise(""))
    return (F.when(F.size(flags) == 0, "All components within thresholds.")
            .when(F.array_contains(flags, V.TAMPER_FLAG), "Driven by forensic tampering evidence.")
            .otherwise(lead))


def flag_groups(documents: DataFrame, results: DataFrame, types: DataFrame) -> DataFrame:
    """Distinct humanised flags per document; documents without any are left out."""
    raised = results.where(F.size("flags") > 0).select("document_id", "flags")
    phrases = F.array_distinct(F.transform("flags", humanise_flag))
    return typed_documents(documents, types).join(raised, "document_id").select(
        "submission_id", "document_id", F.col("original_filename").alias("document"),
        F.col("type_name").alias("type"), phrases.alias("flags"))


def document_list(documents: DataFrame, types: DataFrame) -> DataFrame:
    """The file list of a report."""
    return typed_documents(documents, types).select(
        "submission_id", "document_id", F.col("original_filename").alias("name"), F.col("type_name").alias("type"),
        byte_size(F.col("file_size_bytes")).alias("size"), F.col("processing_status").alias("status"),
        preview_kind(F.col("mime_type")).alias("kind"))


def primary_documents(documents: DataFrame, results: DataFrame, by_type: bool = False) -> DataFrame:
    """The riskiest document per submission (and type); unscored ones rank last
    and ties keep the lowest document id. One combining aggregation, no sort."""
    scores = results.select("document_id", "document_risk_score")
    keys = ["submission_id"] + (["document_type_id"] if by_type else [])
    ranked = documents.join(scores, "document_id", "left")
    rank = F.struct(F.coalesce("document_risk_score", F.lit(-1.0)), -F.col("document_id"))
    return ranked.groupBy(*keys).agg(F.max_by("document_id", rank).alias("document_id"))


def riskiest(judged: DataFrame) -> DataFrame:
    """The riskiest of the documents of each submission, whole; unscored ones rank last
    and ties keep the lowest document id. Documents that lie by submission stay there."""
    order = Window.partitionBy("submission_id").orderBy(F.coalesce("document_risk_score", F.lit(-1.0)).desc(), "document_id")
    return judged.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def percent(score: Column) -> Column:
    return round_to(score * 100, 0).cast("long")


def component_set(results: DataFrame, *extra: str) -> DataFrame:
    """Component rows of the drill-down for each result, in long form. A row without a
    result (``scored`` false, where that column is given) has no stage available."""
    ready, missing = lambda c: F.col(c).isNotNull(), F.lit("Stage not yet available.")
    scored = F.col("scored") if "scored" in results.columns else F.lit(True)
    marks = V.PASS_MARKS
    def row(name: str, score: str, passed: Column, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("component"), percent(F.col(score)).alias("percent"),
                        F.coalesce(passed, F.lit(False)).alias("passed"), F.when(scored, detail).otherwise(missing).alias("detail"))

    classified = F.concat(F.lit("Classified as "), F.when(F.col("is_fake"), "fake").otherwise("genuine"))
    rows = F.array(
        row("text", "text_score", F.col("text_score") >= marks["text"],
            F.when(ready("text_score"), "Fields checked.").otherwise(missing)),
        row("classification", "classification_confidence", F.col("classification_confidence") >= marks["classification"],
            F.when(ready("classification_confidence"), classified).otherwise(missing)),
        row("signature", "signature_score", F.col("signature_distance") <= V.SIGNATURE_DISTANCE,
            F.when(ready("signature_distance"), "Compared against the reference enrolled at registration.")
            .otherwise("Signature region detected, but no reference is enrolled for this vendor yet.")),
        row("stamp", "stamp_score", F.col("stamp_score") >= marks["stamp"],
            F.when(ready("stamp_score"), "Compared against the issuer reference logo.")
            .otherwise("Stamp/logo region detected, but no reference logo is on file for this issuer yet.")))
    return results.select("submission_id", "document_id", *extra, F.inline(rows))


COMPONENT_COLUMNS = ("text_score", "classification_confidence", "signature_score", "signature_distance", "stamp_score", "is_fake")


def component_sets(documents: DataFrame, results: DataFrame, types: DataFrame) -> DataFrame:
    """The drill-down's filters with their component rows: per submission the set
    ``all`` of its riskiest document, and one per document type from that type's
    riskiest document, numbered in the natural order of their labels (``ord``; ``all``
    is 0). A document without a result shows every stage as not yet available.

    The riskiest of a submission is the riskiest of its types' riskiest, so documents
    and results meet once."""
    per_type = primary_documents(documents, results, by_type=True)
    own = results.select("document_id", "document_risk_score", *COMPONENT_COLUMNS, F.lit(True).alias("scored"))
    picked = durable(typed_documents(per_type, types).join(own, "document_id", "left").withColumn("scored", F.coalesce("scored", F.lit(False))))
    line = Window.partitionBy("submission_id")  # a submission has a row per type at most
    risk = [F.coalesce("document_risk_score", F.lit(-1.0)).desc(), F.col("document_id")]
    placed = picked.withColumns({"_rank": F.row_number().over(line.orderBy(*risk)),
                                 "ord": F.row_number().over(line.orderBy(natural_key(F.col("type_name")), F.col("document_type_id")))})
    known = F.col("document_type_id").isNotNull()
    by_type = placed.withColumns({"key": F.when(known, F.concat(F.lit("type-"), "document_type_id")).otherwise("unassigned"), "label": F.col("type_name")})
    overall = placed.where("_rank = 1").withColumns({"key": F.lit("all"), "label": F.lit("All"), "ord": F.lit(0)})
    return component_set(by_type.unionByName(overall), "ord", "key", "label")


# Warning tokens in priority order with their chip and reason.
FIELD_WARNINGS = (
    ("format_mismatch", "Format", "Value does not match the format expected for this field."),
    ("noisy_text", "Noisy", "Value contains character patterns typical of noisy OCR output."),
    ("not_found", "Not found", "This required field was not found in the document."),
    ("low_confidence", "Low confidence", "OCR read this value with low confidence."),
)


def warning_chip(raised: Column) -> Column:
    """Label of the most important warning, NULL when there is none."""
    return F.get(compact(*[F.when(F.array_contains(raised, token), label) for token, label, _ in FIELD_WARNINGS]), 0)


def warning_reasons(raised: Column, confidence: Column) -> Column:
    """Reader's reasons for the raised warnings, in priority order."""
    shown = []
    for token, _, reason in FIELD_WARNINGS:
        text = F.lit(reason)
        if token == "low_confidence":
            figure = round_to(confidence, 0).cast("long").cast("string")
            text = F.coalesce(F.concat(F.lit("OCR read this value with low confidence ("), figure, F.lit("%).")), text)
        shown.append(F.when(F.array_contains(raised, token), text))
    return compact(*shown)
