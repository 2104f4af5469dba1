"""The domain views of ``plans/domain.py`` in SQL, for the side-by-side check."""

from __future__ import annotations

from credence import reference_values as V


def quoted(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def rounded(expr: str, digits: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(20,9)), {digits}) AS DOUBLE)"


def kept(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


_RISK_PARTS = ["text_score", "coalesce(classification_authenticity, classification_confidence)",
               "signature_score", "stamp_score", "tamper_authenticity"]
_WEIGHTED = " + ".join(["0.0::DOUBLE"] + [
    f"CASE WHEN {p} IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE * (1.0::DOUBLE - {p}) END" for p in _RISK_PARTS])
_PRESENT = " + ".join(["0.0::DOUBLE"] + [
    f"CASE WHEN {p} IS NULL THEN 0.0::DOUBLE ELSE 0.2::DOUBLE END" for p in _RISK_PARTS])
_PENALTY = " + ".join(f"CASE WHEN {p} IS NULL THEN 15 ELSE 0 END" for p in _RISK_PARTS[:4])


def band(expr: str) -> str:
    return f"CASE WHEN {expr} IS NULL THEN NULL WHEN {expr} >= 61 THEN 'high' WHEN {expr} >= 31 THEN 'medium' ELSE 'low' END"


_TYPE_ROWS = ", ".join(f"({i}::BIGINT, {quoted(n)}, {quoted(c)}, {quoted(s)})" for i, n, c, s in V.DOCUMENT_TYPES)

# name -> (views it needs, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "document_types": ((), f"SELECT * FROM (VALUES {_TYPE_ROWS}) t(document_type_id, type_name, type_code, issuer_scope)"),
    "line_facts": ((), """
        SELECT *, CAST(floor(l_quantity) AS BIGINT) AS qty, CAST(floor(l_extendedprice) AS BIGINT) AS price,
               CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
               CASE WHEN l_returnflag = 'N' AND l_partkey % 2 = 0 THEN NULL
                    ELSE CAST(floor(l_quantity) AS BIGINT) / 20.0::DOUBLE END AS dist
        FROM lineitem"""),
    "attempts": (("line_facts",), f"""
        SELECT l_orderkey * 8 + l_linenumber AS document_id, l_orderkey AS submission_id,
               l_shipdate, l_partkey, l_suppkey,
               CAST([1, 4, 5, 1, 5, 6, 9, NULL][l_partkey % 8 + 1] AS BIGINT) AS document_type_id,
               ['pdf', 'png', 'jpg'][price % 3 + 1] AS extension,
               ['application/pdf', 'image/png', 'image/jpeg'][price % 3 + 1] AS mime_type,
               price * 40 AS file_size_bytes,
               CASE WHEN qty % 10 = 0 THEN 'failed' WHEN qty % 10 = 1 AND l_linestatus = 'O' THEN 'verifying'
                    ELSE 'completed' END AS processing_status,
               CASE WHEN l_suppkey % 11 <> 0 THEN (100 - tax * 5) / 100.0::DOUBLE END AS text_score,
               CASE WHEN l_partkey % 13 <> 0 THEN (50 + disc * 5) / 100.0::DOUBLE END AS classification_confidence,
               CASE WHEN l_partkey % 13 <> 0 THEN CASE WHEN disc = 10 THEN 0.05::DOUBLE ELSE (90 + disc) / 100.0::DOUBLE END END
                    AS classification_authenticity,
               dist AS signature_distance,
               CASE WHEN dist IS NOT NULL THEN round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - dist / (2.0::DOUBLE * {V.SIGNATURE_DISTANCE}::DOUBLE))), 4) END AS signature_score,
               CASE WHEN NOT (l_returnflag = 'A' AND l_suppkey % 3 = 0) THEN (700 + l_partkey % 300) / 1000.0::DOUBLE END AS stamp_score,
               CASE WHEN price % 17 <> 0 THEN (1000 - price % 600) / 1000.0::DOUBLE END AS tamper_authenticity,
               CASE WHEN price % 17 <> 0 THEN CASE WHEN price % 23 = 0 THEN 0.85::DOUBLE ELSE (price % 70) / 100.0::DOUBLE END END AS tamper_confidence,
               CASE WHEN price % 29 = 0 THEN 'ELA: anomalous compression region at [' || (price % 16 * 16) || ']' END AS region_flag,
               disc = 10 AS is_fake, l_shipdate AS completed_at
        FROM line_facts"""),
    "documents": (("attempts",), """
        SELECT *, 'doc-' || document_id || '.' || extension AS original_filename FROM (
            SELECT *, count(*) OVER (PARTITION BY document_id) AS attempts,
                   row_number() OVER (PARTITION BY document_id ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS rn
            FROM attempts) WHERE rn = 1"""),
    "scored": (("documents",), f"""
        SELECT *, {_WEIGHTED} AS weighted, {_PRESENT} AS present, CAST({_PENALTY} AS DOUBLE) AS penalties,
               coalesce(tamper_confidence, 0) >= 0.8::DOUBLE AS hard_override
        FROM documents WHERE processing_status <> 'verifying'"""),
    "blended": (("scored",), """
        SELECT *, CASE WHEN present > 0 THEN weighted / present * 100.0::DOUBLE ELSE 0 END AS base,
               greatest(0.0::DOUBLE, least(100.0::DOUBLE,
                   (CASE WHEN present > 0 THEN weighted / present * 100.0::DOUBLE ELSE 0 END) + penalties)) AS raw_score
        FROM scored"""),
    "results": (("blended",), f"""
        SELECT *, {rounded('CASE WHEN hard_override THEN greatest(raw_score, 61.0::DOUBLE) ELSE raw_score END', 2)} AS document_risk_score,
               CASE WHEN hard_override THEN 'high' ELSE {band('raw_score')} END AS document_level,
               {kept(
                   "CASE WHEN is_fake AND classification_confidence IS NOT NULL THEN 'classified_as_fake' END",
                   "CASE WHEN classification_confidence < 0.70::DOUBLE THEN 'low_classification_confidence' END",
                   "CASE WHEN text_score < 0.70::DOUBLE THEN 'missing_required_fields:tin,date_issued' END",
                   f"CASE WHEN signature_distance > {V.SIGNATURE_DISTANCE}::DOUBLE THEN 'signature_mismatch' END",
                   "CASE WHEN signature_distance IS NULL THEN 'no_signature_reference' END",
                   "CASE WHEN stamp_score < 0.80::DOUBLE THEN 'stamp_mismatch' END",
                   "CASE WHEN stamp_score IS NULL THEN 'unreferenced_logo' END",
                   "region_flag",
                   "CASE WHEN hard_override THEN 'Document tampering suspected' END",
                   "CASE WHEN text_score IS NULL THEN 'Text validation unavailable' END",
                   "CASE WHEN coalesce(classification_authenticity, classification_confidence) IS NULL THEN 'Classification unavailable' END",
                   "CASE WHEN signature_score IS NULL THEN 'Signature verification unavailable' END",
                   "CASE WHEN stamp_score IS NULL THEN 'Stamp verification unavailable' END",
                   "CASE WHEN processing_status = 'failed' THEN 'processing_failed' END")} AS flags
        FROM blended"""),
    "submission_rows": ((), """
        SELECT o_orderkey AS submission_id, o_custkey AS vendor_id,
               CASE o_orderstatus WHEN 'P' THEN 'pending_review' WHEN 'O' THEN 'processing'
                    ELSE CASE WHEN o_orderkey % 3 <> 0 THEN 'approved' ELSE 'resubmission_requested' END END AS status,
               o_orderdate AS created_at,
               CASE WHEN o_orderstatus = 'F' THEN -(o_custkey % 25) - 1 END AS reviewed_by,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 3 DAY END AS reviewed_at,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN 'Priority ' || o_orderpriority END AS review_comments
        FROM orders"""),
    "submission_scores": (("results",), """
        SELECT submission_id, max(document_risk_score) AS top_score FROM results GROUP BY submission_id"""),
    "submissions": (("submission_rows", "submission_scores"), f"""
        SELECT *, {band('composite_risk_score')} AS risk_level FROM (
            SELECT r.*, CASE WHEN status <> 'processing' THEN top_score END AS composite_risk_score
            FROM submission_rows r LEFT JOIN submission_scores s USING (submission_id))"""),
    "officers": ((), """
        SELECT CAST(-n_nationkey - 1 AS BIGINT) AS user_id, 'Officer ' || n_name AS name, lower(n_name) || '@office.test' AS email,
               CASE WHEN n_regionkey = 0 THEN 'admin' ELSE 'compliance_officer' END AS role, TRUE AS is_active,
               TIMESTAMP '2022-01-01' + to_days(n_nationkey) AS created_at,
               TIMESTAMP '2022-01-02' + to_days(n_nationkey) AS email_verified_at,
               CAST(NULL AS TIMESTAMP) AS signature_enrolled_at
        FROM nation"""),
    "users": (("officers",), """
        SELECT c_custkey AS user_id, c_name AS name, lower(c_name) || '@vendor.test' AS email, 'vendor' AS role,
               c_custkey % 10 <> 0 AS is_active,
               TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS created_at,
               CASE WHEN c_custkey % 4 <> 0 THEN TIMESTAMP '2023-01-02' + to_days(CAST(c_custkey % 365 AS INTEGER)) END AS email_verified_at,
               CASE WHEN c_custkey % 3 <> 0 THEN TIMESTAMP '2023-01-03' + to_days(CAST(c_custkey % 365 AS INTEGER)) END AS signature_enrolled_at
        FROM customer
        UNION ALL SELECT * FROM officers"""),
    "vendors": ((), """
        SELECT c_custkey AS vendor_id, c_custkey AS user_id,
               upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' Works ' || c_custkey AS company_name,
               CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN '' ELSE 'REG-' || (c_custkey + 100000) END AS registration_number,
               CASE WHEN c_custkey % 2 = 0 THEN 'DTI ' || (c_custkey + 2000) ELSE '' END AS dti_registration_number,
               CASE WHEN c_custkey % 3 = 0 THEN 'CS' || (c_custkey + 2000000) END AS sec_registration_number,
               lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '-118-' || CASE WHEN c_custkey % 9 = 0 THEN '90' ELSE '902' END AS tin,
               ['sole_proprietorship', 'partnership', 'corporation'][c_custkey % 3 + 1] AS business_entity_type,
               ['pending', 'under_review', 'approved', 'rejected'][c_nationkey % 4 + 1] AS status,
               CASE WHEN c_acctbal >= 0 THEN floor(c_acctbal / 100) END AS risk_score,
               c_custkey || ' Market St' AS business_street,
               CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'Barangay ' || (c_custkey % 40) END AS business_barangay,
               upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS business_city,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'Metro' END AS business_province,
               lpad(CAST(c_custkey % 9999 AS VARCHAR), 4, '0') AS business_postal_code,
               TIMESTAMP '2023-01-01' + to_days(CAST(c_custkey % 365 AS INTEGER)) AS registered_at
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""),
    "audit_logs": ((), """
        SELECT event_id AS log_id,
               CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 41 = 0 THEN user_id + 1000000000 ELSE user_id END AS user_id,
               CASE event_type WHEN 'view' THEN 'auth.login' WHEN 'click' THEN 'user.role_changed' WHEN 'signup' THEN 'user.created'
                    WHEN 'purchase' THEN 'submission.approved' ELSE 'ml_model.missing' END AS action,
               CASE event_type WHEN 'view' THEN NULL WHEN 'purchase' THEN 'Domain\\Review\\Submission'
                    WHEN 'error' THEN 'Domain\\Models\\MlModel' ELSE 'Domain\\Accounts\\User' END AS entity_type,
               CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS BIGINT) END AS entity_id,
               props AS details, '10.0.' || (user_id % 256) || '.' || (event_id % 250) AS ip_address, ts AS created_at
        FROM events"""),
    "notifications": ((), """
        SELECT event_id AS notification_id, user_id,
               CASE event_type WHEN 'error' THEN 'high_risk_alert' WHEN 'purchase' THEN 'decision_made' ELSE 'general' END AS type,
               value >= 20 AS is_read, ts AS created_at
        FROM events"""),
}


#: Extra views that cost much and are read more than once.
ONCE = {"sheets", "lined", "fields", "cwords", "graded"}


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a statement with the views it needs, dependencies first. Views that
    others read several times are worked out once."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for dependency in VIEWS[name][0]:
            need(dependency)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    parts = [f"{name} AS ({VIEWS[name][1]})" for name in ordered]
    parts += [f"{name} AS {'MATERIALIZED ' * (name in ONCE)}({sql})" for name, sql in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
