"""Registered queries over the officer screens, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions.dates import stamp
from credence.functions.formatting import (
    FIELD_ACRONYMS, FLAG_CATEGORIES, flag_category, humanise_flag, submission_reference)
from credence.functions.numbers import round_to
from credence.operators import ordering, review
from credence.operators.rollup import finalise_submissions
from credence.plans import domain as D
from credence.plans.domain_sql import quoted, with_views
from credence.plans.registry import query

REVIEW_DAY = "1998-06-15 12:00:00"


def _upper_first(x: str) -> str:
    return f"(upper(substr({x}, 1, 1)) || substr({x}, 2))"


def humanise(x: str) -> str:
    words = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in FIELD_ACRONYMS.items())
    label = ("CASE trim(k) WHEN 'trn_no' THEN 'TRN' WHEN 'tax_types' THEN 'Registered Activities' ELSE "
             f"array_to_string(list_transform(string_split(trim(k), '_'), lambda w: CASE w {words} ELSE {_upper_first('w')} END), ' ') END")
    listed = f"list_filter(string_split(substr({x}, 25), ','), lambda k: trim(k) <> '')"
    return (f"CASE WHEN contains({x}, ' ') THEN {x} WHEN starts_with({x}, 'missing_required_fields:') THEN "
            f"'Missing required fields: ' || array_to_string(list_transform({listed}, lambda k: {label}), ', ') "
            f"ELSE {_upper_first(f'replace({x}, chr(95), chr(32))')} END")


def category(x: str) -> str:
    arms = " ".join("WHEN " + " OR ".join(f"contains(lower({x}), {quoted(w)})" for w in words) + f" THEN {quoted(name)}"
                    for name, words in FLAG_CATEGORIES)
    return f"CASE {arms} ELSE 'other' END"


SUMMARY = {
    "typed": """SELECT submission_id, coalesce(type_name, 'Unassigned') AS t, min(document_id) AS f
                FROM documents LEFT JOIN document_types USING (document_type_id) GROUP BY 1, 2""",
    "type_lists": "SELECT submission_id, string_agg(t, ', ' ORDER BY f) AS document_type FROM typed GROUP BY 1",
    "doc_counts": "SELECT submission_id, count(*) AS documents_count FROM documents GROUP BY 1",
    "flag_rows": """SELECT submission_id, document_id, original_filename, completed_at, unnest(flags) AS flag,
                    generate_subscripts(flags, 1) - 1 AS pos FROM results""",
    "phrases": f"""SELECT submission_id, phrase, min(document_id * 1000 + pos) AS f FROM
                   (SELECT *, {humanise('flag')} AS phrase FROM flag_rows) GROUP BY 1, 2""",
    "flag_lists": "SELECT submission_id, list(phrase ORDER BY f) AS flags FROM phrases GROUP BY 1",
    "summary": """
        SELECT s.submission_id, printf('SUB-%05d', s.submission_id) AS ref, coalesce(v.company_name, '—') AS company,
               coalesce(u.name, '—') AS vendor, s.vendor_id, coalesce(t.document_type, '—') AS document_type,
               coalesce(c.documents_count, 0) AS documents_count, s.created_at AS submitted_at,
               coalesce(f.flags, []) AS flags,
               CAST(round(CAST(s.composite_risk_score AS DECIMAL(20,9)), 0) AS BIGINT) AS risk_score,
               s.composite_risk_score, s.risk_level, s.status,
               CASE WHEN s.status IN ('approved', 'resubmission_requested') THEN s.status END AS decision,
               r.name AS reviewed_by, s.reviewed_at, s.review_comments
        FROM submissions s LEFT JOIN vendors v USING (vendor_id) LEFT JOIN users u ON u.user_id = v.user_id
        LEFT JOIN users r ON r.user_id = s.reviewed_by
        LEFT JOIN type_lists t ON t.submission_id = s.submission_id
        LEFT JOIN doc_counts c ON c.submission_id = s.submission_id
        LEFT JOIN flag_lists f ON f.submission_id = s.submission_id""",
}
_NEEDS = ("submissions", "vendors", "users", "documents", "results", "document_types")
_SHOWN_SQL = """submission_id, ref, company, vendor, document_type, documents_count,
    strftime(submitted_at, '%Y-%m-%d %H:%M:%S') AS submitted_at, array_to_string(flags, '; ') AS flags, risk_score,
    risk_level, status, decision, reviewed_by, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at, review_comments"""


def summary_sql(body: str) -> str:
    return with_views(body, *_NEEDS, extra=SUMMARY)


def _summary(spark, folder, *status):
    """Queue rows of the submissions in a status. Documents are read once, only those of
    these submissions: scores, types and flags come from one digest, which is joined to
    the submissions once."""
    rows = D.submission_rows(spark, folder).where(F.col("status").isin(*status))
    digest = review.digests(D.judged(spark, folder, rows), D.document_types(spark))
    return review.summary_rows(D.rated(rows, digest), D.vendors(spark, folder), D.users(spark, folder))


def _shown(rows):
    return rows.select("submission_id", "ref", "company", "vendor", "document_type", "documents_count",
                       stamp(F.col("submitted_at")).alias("submitted_at"), F.array_join("flags", "; ").alias("flags"),
                       "risk_score", "risk_level", "status", "decision", "reviewed_by",
                       stamp(F.col("reviewed_at")).alias("reviewed_at"), "review_comments")


@query("pending_queue", "C1 D3 D4 E26 G1", summary_sql(
    f"SELECT {_SHOWN_SQL} FROM summary WHERE status = 'pending_review' ORDER BY composite_risk_score DESC NULLS LAST, submission_id"))
def pending_queue(spark, folder):
    return _shown(review.pending(_summary(spark, folder, review.PENDING)).orderBy(*review.by_urgency()))


@query("pending_queue_search", "C1 C5", summary_sql(
    f"""SELECT {_SHOWN_SQL} FROM summary WHERE status = 'pending_review' AND risk_level = 'medium'
        AND contains(lower(ref || ' ' || company || ' ' || vendor || ' ' || document_type), 'permit')"""))
def pending_queue_search(spark, folder):
    return _shown(review.pending(_summary(spark, folder, review.PENDING), risk="medium", term=" Permit "))


@query("archived_reports", "C1 C2 C5 G1", summary_sql(
    f"""SELECT {_SHOWN_SQL} FROM summary WHERE status IN ('approved', 'resubmission_requested')
        AND status = 'resubmission_requested' ORDER BY reviewed_at DESC, submission_id"""))
def archived_reports(spark, folder):
    rows = review.archived(_summary(spark, folder, "resubmission_requested"), decision="resubmission_requested")
    return _shown(rows.orderBy(F.col("reviewed_at").desc_nulls_last(), "submission_id"))


@query("urgent_submissions", "G3", summary_sql(
    "SELECT submission_id, ref, risk_score, risk_level FROM summary WHERE status = 'pending_review' "
    "ORDER BY composite_risk_score DESC NULLS LAST, submission_id LIMIT 5"))
def urgent_submissions(spark, folder):
    """Top five of the queue: the score alone decides, so no display join runs."""
    rows = D.submissions(spark, folder).where(F.col("status") == review.PENDING)
    top = rows.orderBy(*review.by_urgency()).limit(5)
    return top.select("submission_id", submission_reference(F.col("submission_id")).alias("ref"),
                      round_to(F.col("composite_risk_score"), 0).cast("long").alias("risk_score"), "risk_level")


@query("dashboard_kpis", "E2 E3 E7", summary_sql(
    f"""SELECT count(*) FILTER (status = 'pending_review') AS pending,
        count(*) FILTER (status = 'pending_review' AND len(flags) > 0 AND submitted_at >= date_trunc('day', TIMESTAMP '{REVIEW_DAY}')) AS flagged_today,
        count(*) FILTER (status = 'pending_review' AND risk_level = 'high') AS high_risk,
        CASE WHEN count(*) FILTER (status IN ('approved', 'resubmission_requested')) = 0 THEN '—' ELSE
        CAST(CAST(round(CAST(count(*) FILTER (status = 'approved') * 100 / count(*) FILTER (status IN ('approved', 'resubmission_requested')) AS DECIMAL(20,6)), 0) AS BIGINT) AS VARCHAR) || '%' END AS approval_rate
        FROM summary"""))
def dashboard_kpis(spark, folder):
    """Only the columns the figures need: states, scores and whether any flag exists."""
    flagged = D.results(spark, folder).where(F.size("flags") > 0).groupBy("submission_id").agg(F.lit(1).alias("one"))
    rows = D.submissions(spark, folder).join(flagged, "submission_id", "left").select(
        "status", "risk_level", F.col("created_at").alias("submitted_at"),
        F.when(F.col("one").isNotNull(), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    return review.dashboard_kpis(rows, F.lit(REVIEW_DAY).cast("timestamp_ntz"))


@query("status_kpis_by_vendor", "A1 E1 E2 E8", with_views(
    """SELECT vendor_id, count(*) AS total, count(*) FILTER (status IN ('processing', 'pending_review')) AS in_progress,
       count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'resubmission_requested') AS resubmission_requested
       FROM submission_rows GROUP BY vendor_id""", "submission_rows"))
def status_kpis_by_vendor(spark, folder):
    return review.status_kpis(D.submission_rows(spark, folder), by="vendor_id")


@query("activity_feed", "B30 G3", with_views(
    """SELECT log_id, CASE WHEN ends_with(action, '.approved') THEN 'check-circle' WHEN ends_with(action, '.resubmission_requested') THEN 'arrow-path'
       WHEN starts_with(action, 'ml_model.') THEN 'cpu-chip' ELSE 'bolt' END AS icon,
       array_to_string(list_transform(string_split(replace(replace(action, '.', ' '), '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
       || ' — ' || coalesce(name, 'System') AS text, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS at
       FROM (SELECT * FROM audit_logs ORDER BY created_at DESC, log_id DESC LIMIT 6) l LEFT JOIN (SELECT user_id, name FROM users) u USING (user_id)""",
    "audit_logs", "users"))
def activity_feed(spark, folder):
    rows = review.activity_feed(D.audit_logs(spark, folder), D.users(spark, folder))
    return rows.select("log_id", "icon", "text", stamp(F.col("created_at")).alias("at"))


_LOG = f"""SELECT {category('flag')} AS type, CASE WHEN risk_level = 'high' THEN 'high' ELSE 'medium' END AS severity, flag AS title,
    original_filename AS detail, coalesce(completed_at, submitted_at) AS raised_at, submission_id, document_id, pos, ref, vendor, company, document_type
    FROM flag_rows JOIN summary USING (submission_id) WHERE status IN ('pending_review', 'approved', 'resubmission_requested')"""
_LOG_SHOWN = """type, severity, title, detail, strftime(raised_at, '%Y-%m-%d %H:%M:%S') AS raised_at, submission_id, ref, vendor, company, document_type"""


def _log(spark, folder):
    summary = _summary(spark, folder, *review.PROCESSED)
    return review.risk_log(summary, D.results(spark, folder, _processed(spark, folder)))


def _processed(spark, folder):
    return D.submission_rows(spark, folder).where(F.col("status").isin(*review.PROCESSED))


def _log_shown(rows, *extra):
    return rows.select(*extra, "type", "severity", "title", "detail", stamp(F.col("raised_at")).alias("raised_at"),
                       "submission_id", "ref", "vendor", "company", "document_type")


@query("risk_log_numbered", "B15 G5 G6", summary_sql(
    f"""SELECT row_number() OVER (ORDER BY raised_at DESC, submission_id, document_id, pos) AS id,
        title, type, severity, submission_id, document_id, CAST(pos AS INTEGER) AS pos FROM ({_LOG})"""))
def risk_log_numbered(spark, folder):
    """The whole log with its running number."""
    processed = D.submissions(spark, folder, *review.PROCESSED).select(
        "submission_id", "risk_level", F.col("created_at").alias("submitted_at"), "status")
    bare = processed.withColumns({c: F.lit("") for c in ("ref", "vendor", "company", "document_type")})
    log = review.risk_log(bare, D.results(spark, folder, _processed(spark, folder)))
    slim = log.select("raised_at", "submission_id", "document_id", "pos", "title", "type", "severity")
    return ordering.number_rows(slim, review.log_order()).drop("raised_at")


@query("risk_log_search", "C5 C8 G6", summary_sql(
    f"""SELECT {_LOG_SHOWN} FROM ({_LOG}) WHERE type = 'signature_mismatch' AND severity = 'high'
        AND abs(date_sub('hour', raised_at, TIMESTAMP '1999-03-01 06:00:00')) <= 8760
        AND contains(lower(ref || ' ' || company || ' ' || vendor || ' ' || title || ' ' || document_type), 'contract')"""))
def risk_log_search(spark, folder):
    rows = review.filter_log(_log(spark, folder), "signature_mismatch", "high", 8760,
                             F.lit("1999-03-01 06:00:00").cast("timestamp_ntz"), "contract")
    return _log_shown(rows)


@query("flag_humanised", "B14 B15", summary_sql(
    f"SELECT flag, {humanise('flag')} AS phrase, {category('flag')} AS category, count(*) AS n FROM flag_rows GROUP BY 1, 2, 3"))
def flag_humanised(spark, folder):
    counted = review.flag_rows(D.results(spark, folder)).groupBy("flag").agg(F.count("*").alias("n"))
    return counted.select("flag", humanise_flag(F.col("flag")).alias("phrase"),
                          flag_category(F.col("flag")).alias("category"), "n")


@query("vendor_directory", "E5 C5 G1", with_views(
    """SELECT v.vendor_id, v.company_name AS company, coalesce(u.name, '—') AS contact, coalesce(v.registration_number, '') AS registration_number,
       v.status, coalesce(n, 0) AS submissions_count, coalesce(u.signature_enrolled_at IS NOT NULL, FALSE) AS enrolled
       FROM vendors v LEFT JOIN users u USING (user_id) LEFT JOIN (SELECT vendor_id, count(*) AS n FROM submission_rows GROUP BY 1) c USING (vendor_id)
       WHERE contains(lower(v.company_name || ' ' || coalesce(u.name, '—') || ' ' || coalesce(v.registration_number, '')), 'reg-10')""",
    "vendors", "users", "submission_rows"))
def vendor_directory(spark, folder):
    rows = review.vendor_directory(D.vendors(spark, folder), D.users(spark, folder),
                                   D.submission_rows(spark, folder), term="REG-10")
    return rows.drop("registered_at").orderBy("company")


@query("vendor_profiles", "B27 B29 D15 E40", with_views(
    """SELECT v.vendor_id, v.company_name AS company, coalesce(u.name, '—') AS contact,
       coalesce(nullif(nullif(registration_number, ''), '0'), nullif(nullif(dti_registration_number, ''), '0'), nullif(nullif(sec_registration_number, ''), '0'), '—') AS registration_number,
       array_to_string(list_filter([business_street, business_barangay, business_city, business_province, business_postal_code], lambda x: x IS NOT NULL AND x <> '' AND x <> '0'), ', ') AS address,
       v.status, v.risk_score, CASE WHEN v.risk_score >= 61 THEN 'high' WHEN v.risk_score >= 31 THEN 'medium' WHEN v.risk_score IS NOT NULL THEN 'low' END AS risk_level,
       coalesce(n, 0) AS submissions_count, strftime(latest, '%Y-%m-%d %H:%M:%S') AS last_submission_at, last_id AS last_submission_id,
       u.signature_enrolled_at IS NOT NULL AS enrolled
       FROM vendors v LEFT JOIN users u USING (user_id) LEFT JOIN (
         SELECT vendor_id, count(*) AS n, max(created_at) AS latest, arg_max(submission_id, (created_at, submission_id)) AS last_id
         FROM submission_rows GROUP BY 1) c USING (vendor_id)""", "vendors", "users", "submission_rows"))
def vendor_profiles(spark, folder):
    rows = review.vendor_profiles(D.vendors(spark, folder), D.users(spark, folder), D.submission_rows(spark, folder))
    return rows.withColumn("last_submission_at", stamp(F.col("last_submission_at")))


@query("risk_drivers", "E29", summary_sql(
    """SELECT submission_id, CASE WHEN len(flags) = 0 THEN 'All components within thresholds.'
       WHEN list_contains(flags, 'Document tampering suspected') THEN 'Driven by forensic tampering evidence.'
       ELSE 'Driven by: ' || array_to_string(flags[1:2], '; ') || CASE WHEN len(flags) > 2 THEN '…' ELSE '' END END AS driver FROM summary"""))
def risk_drivers(spark, folder):
    phrases = review.flag_rows(D.results(spark, folder)).withColumn("phrase", humanise_flag(F.col("flag")))
    lists = review.distinct_in_order(phrases, ["submission_id"], "phrase", ["document_id", "pos"], "flags")
    rows = D.submission_rows(spark, folder).select("submission_id").join(lists, "submission_id", "left")
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    return rows.select("submission_id", review.risk_driver(flags).alias("driver"))


@query("flags_by_document", "E28", with_views(
    f"""SELECT d.submission_id, d.document_id, d.original_filename AS document, coalesce(type_name, 'Unassigned') AS type, listed AS flags
        FROM documents d LEFT JOIN document_types USING (document_type_id) JOIN (
          SELECT document_id, string_agg(phrase, '; ' ORDER BY f) AS listed FROM (
            SELECT document_id, {humanise('flag')} AS phrase, min(pos) AS f FROM (
              SELECT document_id, unnest(flags) AS flag, generate_subscripts(flags, 1) AS pos FROM results) GROUP BY 1, 2)
          GROUP BY 1) g ON g.document_id = d.document_id""", "documents", "results", "document_types"))
def flags_by_document(spark, folder):
    rows = review.flag_groups(D.documents(spark, folder), D.results(spark, folder), D.document_types(spark))
    return rows.withColumn("flags", F.array_join("flags", "; "))


@query("document_list", "B13 B16 B17 D4", with_views(
    """SELECT submission_id, document_id, original_filename AS name, coalesce(type_name, 'Unassigned') AS type,
       CASE WHEN file_size_bytes < 1048576 THEN format('{:,}', CAST(floor(r / 10) AS BIGINT)) || '.' || CAST(r % 10 AS VARCHAR) || ' KB'
            ELSE format('{:,}', CAST(floor(m / 100) AS BIGINT)) || '.' || lpad(CAST(m % 100 AS VARCHAR), 2, '0') || ' MB' END AS size,
       processing_status AS status, CASE WHEN starts_with(mime_type, 'image/') THEN 'image' WHEN mime_type = 'application/pdf' THEN 'pdf' ELSE 'other' END AS kind
       FROM (SELECT *, CAST(round(CAST(file_size_bytes / 1024 AS DECIMAL(20,6)) * 10, 0) AS BIGINT) AS r,
             CAST(round(CAST(file_size_bytes / 1048576 AS DECIMAL(20,6)) * 100, 0) AS BIGINT) AS m FROM documents)
       LEFT JOIN document_types USING (document_type_id)""", "documents", "document_types"))
def document_list(spark, folder):
    return review.document_list(D.documents(spark, folder), D.document_types(spark))


@query("primary_document_per_type", "E27 G11", with_views(
    """SELECT submission_id, coalesce(type_name, 'Unassigned') AS label, arg_max(d.document_id, (coalesce(document_risk_score, -1), -d.document_id)) AS document_id
       FROM documents d LEFT JOIN (SELECT document_id, document_risk_score FROM results) r USING (document_id)
       LEFT JOIN document_types USING (document_type_id) GROUP BY submission_id, document_type_id, type_name""",
    "documents", "results", "document_types"))
def primary_document_per_type(spark, folder):
    picks = review.primary_documents(D.documents(spark, folder), D.results(spark, folder), by_type=True)
    labelled = review.typed_documents(picks, D.document_types(spark)).withColumnRenamed("type_name", "label")
    return labelled.select("submission_id", "label", "document_id").orderBy("submission_id", ordering.natural_key(F.col("label")))


@query("component_breakdown", "E27", with_views(
    f"""SELECT submission_id, document_id, component, CAST(round(CAST(score * 100 AS DECIMAL(20,9)), 0) AS BIGINT) AS percent, passed, detail FROM (
        SELECT r.submission_id, r.document_id, unnest([
          {{'component': 'text', 'score': text_score, 'passed': coalesce(text_score >= 0.70::DOUBLE, FALSE),
            'detail': CASE WHEN text_score IS NULL THEN 'Stage not yet available.' ELSE 'Fields checked.' END}},
          {{'component': 'classification', 'score': classification_confidence, 'passed': coalesce(classification_confidence >= 0.70::DOUBLE, FALSE),
            'detail': CASE WHEN classification_confidence IS NULL THEN 'Stage not yet available.' WHEN is_fake THEN 'Classified as fake' ELSE 'Classified as genuine' END}},
          {{'component': 'signature', 'score': signature_score, 'passed': coalesce(signature_distance <= 1.243976::DOUBLE, FALSE),
            'detail': CASE WHEN signature_distance IS NULL THEN 'Signature region detected, but no reference is enrolled for this vendor yet.' ELSE 'Compared against the reference enrolled at registration.' END}},
          {{'component': 'stamp', 'score': stamp_score, 'passed': coalesce(stamp_score >= 0.85::DOUBLE, FALSE),
            'detail': CASE WHEN stamp_score IS NULL THEN 'Stamp/logo region detected, but no reference logo is on file for this issuer yet.' ELSE 'Compared against the issuer reference logo.' END}}], recursive := true)
        FROM results r JOIN (SELECT submission_id, arg_max(d.document_id, (coalesce(document_risk_score, -1), -d.document_id)) AS document_id
          FROM documents d LEFT JOIN (SELECT document_id, document_risk_score FROM results) USING (document_id) GROUP BY 1) p USING (document_id))""",
    "documents", "results"))
def component_breakdown(spark, folder):
    """Component rows of each submission's riskiest document."""
    return review.component_set(review.riskiest(D.judged(spark, folder)).where("scored").drop("scored"))


_SET_SQL = """SELECT submission_id, document_id, CAST(ord AS INTEGER) AS ord, key, label, component, CAST(round(CAST(score * 100 AS DECIMAL(20,9)), 0) AS BIGINT) AS percent, passed, CASE WHEN scored THEN detail ELSE 'Stage not yet available.' END AS detail FROM (
    SELECT submission_id, document_id, ord, key, label, scored, unnest([
      {'component': 'text', 'score': text_score, 'passed': coalesce(text_score >= 0.70::DOUBLE, FALSE), 'detail': CASE WHEN text_score IS NULL THEN 'Stage not yet available.' ELSE 'Fields checked.' END},
      {'component': 'classification', 'score': classification_confidence, 'passed': coalesce(classification_confidence >= 0.70::DOUBLE, FALSE),
        'detail': CASE WHEN classification_confidence IS NULL THEN 'Stage not yet available.' WHEN is_fake THEN 'Classified as fake' ELSE 'Classified as genuine' END},
      {'component': 'signature', 'score': signature_score, 'passed': coalesce(signature_distance <= 1.243976::DOUBLE, FALSE),
        'detail': CASE WHEN signature_distance IS NULL THEN 'Signature region detected, but no reference is enrolled for this vendor yet.' ELSE 'Compared against the reference enrolled at registration.' END},
      {'component': 'stamp', 'score': stamp_score, 'passed': coalesce(stamp_score >= 0.85::DOUBLE, FALSE),
        'detail': CASE WHEN stamp_score IS NULL THEN 'Stamp/logo region detected, but no reference logo is on file for this issuer yet.' ELSE 'Compared against the issuer reference logo.' END}], recursive := true) FROM (
      SELECT *, row_number() OVER (PARTITION BY submission_id ORDER BY lower(label), document_type_id) AS ord, coalesce('type-' || document_type_id, 'unassigned') AS key FROM best
      UNION ALL BY NAME SELECT * REPLACE ('All' AS label), 0 AS ord, 'all' AS key FROM best QUALIFY row_number() OVER (PARTITION BY submission_id ORDER BY coalesce(risk, -1) DESC, document_id) = 1))"""
_BEST_SQL = """SELECT d.submission_id, d.document_id, d.document_type_id, coalesce(type_name, 'Unassigned') AS label, r.document_id IS NOT NULL AS scored, r.document_risk_score AS risk, r.text_score, r.classification_confidence, r.signature_score, r.signature_distance, r.stamp_score, r.is_fake
    FROM documents d LEFT JOIN results r USING (document_id) LEFT JOIN document_types t ON t.document_type_id = d.document_type_id
    QUALIFY row_number() OVER (PARTITION BY d.submission_id, d.document_type_id ORDER BY coalesce(r.document_risk_score, -1) DESC, d.document_id) = 1"""


@query("component_sets_by_type", "E27 G11", with_views(_SET_SQL, "documents", "results", "document_types", extra={"best": _BEST_SQL}))
def component_sets_by_type(spark, folder):
    """The sets of the drill-down: all, and one per type of document present."""
    return review.component_sets(D.documents(spark, folder), D.results(spark, folder), D.document_types(spark))


@query("document_risk", "E20 E21 E36", with_views(
    """SELECT document_id, submission_id, document_risk_score AS score, document_level AS level, hard_override,
       CAST(round(CAST(base AS DECIMAL(20,9)), 2) AS DOUBLE) AS base, penalties FROM results""", "results"))
def document_risk(spark, folder):
    rows = D.results(spark, folder)
    return rows.select("document_id", "submission_id", "risk.score", "risk.level", "risk.hard_override", "risk.base",
                       "risk.penalties")


@query("submission_rollup", "D1 E24 E25 D6", with_views(
    """SELECT submission_id, CASE WHEN ready THEN 'pending_review' ELSE 'processing' END AS status, CASE WHEN ready THEN top END AS composite_risk_score,
       CASE WHEN NOT ready OR top IS NULL THEN NULL WHEN top >= 61 THEN 'high' WHEN top >= 31 THEN 'medium' ELSE 'low' END AS risk_level,
       CASE WHEN ready THEN concat_ws('; ', nullif(listed, ''), CASE WHEN failed > 0 THEN 'Processing failed for ' || failed || ' document(s)' END) END AS flags
       FROM (SELECT s.submission_id, coalesce(bool_and(d.processing_status IN ('completed', 'failed')), TRUE) AS ready,
               count(*) FILTER (d.processing_status = 'failed') AS failed
             FROM (SELECT * FROM submission_rows WHERE status = 'processing') s LEFT JOIN documents d USING (submission_id) GROUP BY 1) g
       LEFT JOIN (SELECT submission_id, max(document_risk_score) AS top FROM results GROUP BY 1) USING (submission_id)
       LEFT JOIN (SELECT submission_id, string_agg(flag, '; ' ORDER BY f) AS listed FROM (
           SELECT submission_id, flag, min(document_id * 1000 + pos) AS f FROM (
             SELECT submission_id, document_id, unnest(flags) AS flag, generate_subscripts(flags, 1) AS pos FROM results) GROUP BY 1, 2) GROUP BY 1) USING (submission_id)""",
    "submission_rows", "documents", "results"))
def submission_rollup(spark, folder):
    rows = finalise_submissions(D.submission_rows(spark, folder), D.documents(spark, folder), D.results(spark, folder))
    return rows.select("submission_id", "status", "composite_risk_score", "risk_level",
                       F.array_join("flags", "; ").alias("flags"))
