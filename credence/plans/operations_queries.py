"""Registered queries: audit trail, accounts, settings, retention, mutations."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.dates import stamp
from credence.functions.formatting import initials
from credence.operators import accounts, audit, models, mutate, notices, ordering, retention, settings
from credence.operators.crosscheck import declared_against_extracted
from credence.operators.review import distinct_in_order, flag_rows
from credence.operators.verify import usable_reference
from credence.plans import domain as D
from credence.plans.domain_sql import quoted, with_views
from credence.plans.registry import query
from credence.session import stored

NOW = "2024-01-31 00:00:00"
TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"
LOG_COLUMNS = ("log_id", "user_id", "action", "entity_type", "entity_id", "ip_address", "details")
LOG_SQL = ", ".join(LOG_COLUMNS) + ", " + TS.format("created_at") + " AS created_at"


def _logs(rows):
    return rows.select(*LOG_COLUMNS, stamp(F.col("created_at")).alias("created_at"))


@query("audit_search", "C4 C6 C9 C10", with_views(
    f"""SELECT {LOG_SQL} FROM audit_logs WHERE (action ILIKE '%_0%7%' OR coalesce(entity_type, '') ILIKE '%_0%7%' OR ip_address ILIKE '%_0%7%' OR details ILIKE '%_0%7%')
        AND starts_with(action, 'submission.') AND entity_type = 'Domain\\Review\\Submission'
        AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25'""", "audit_logs"))
def audit_search(spark, folder):
    return _logs(audit.filtered(D.audit_logs(spark, folder), term=" _0%7 ", module="submission",
                                entity_type="Domain\\Review\\Submission", start="2024-01-05", end="2024-01-25"))


@query("audit_totals", "C13 E4", with_views(
    "SELECT count(*) AS matching, count(DISTINCT user_id) AS actors FROM audit_logs WHERE action = 'user.created' AND created_at >= TIMESTAMP '2024-01-10'",
    "audit_logs"))
def audit_totals(spark, folder):
    return audit.totals(audit.filtered(D.audit_logs(spark, folder), action="user.created", start="2024-01-10"))


@query("audit_last_week", "C7", with_views(
    f"SELECT {LOG_SQL} FROM audit_logs WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAY AND created_at <= TIMESTAMP '{NOW}'", "audit_logs"))
def audit_last_week(spark, folder):
    return _logs(audit.preset_range(D.audit_logs(spark, folder), "7d", NOW))


@query("audit_page_three", "G1 G4", with_views(
    f"SELECT {LOG_SQL} FROM (SELECT * FROM audit_logs ORDER BY created_at DESC, log_id DESC LIMIT 25 OFFSET 50)", "audit_logs"))
def audit_page_three(spark, folder):
    return _logs(ordering.page_of(D.audit_logs(spark, folder), audit.newest_first(), page=3, per_page=25))


@query("audit_page_after", "G4", with_views(
    f"""SELECT {LOG_SQL} FROM (SELECT * FROM audit_logs WHERE created_at < TIMESTAMP '2024-01-20 12:00:00'
        ORDER BY created_at DESC, log_id DESC LIMIT 50)""", "audit_logs"))
def audit_page_after(spark, folder):
    rows = ordering.page_after(D.audit_logs(spark, folder), "created_at", "log_id",
                               (datetime.datetime(2024, 1, 20, 12), 0), per_page=50)
    return _logs(rows)


@query("audit_export", "A7 D3", with_views(
    """SELECT log_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S+00:00') AS timestamp, coalesce(u.name, '(deleted user)') AS user,
       coalesce(u.email, '') AS email, coalesce(u.role, '') AS role, action, coalesce(regexp_extract(entity_type, '([^\\\\]+)$', 1), '') AS entity,
       entity_id, ip_address, coalesce(details, '') AS details
       FROM audit_logs l
       LEFT JOIN (SELECT user_id, name, email, role FROM users) u USING (user_id)""", "audit_logs", "users"))
def audit_export(spark, folder):
    return audit.export_rows(audit.filtered(D.audit_logs(spark, folder)), D.users(spark, folder))


@query("audit_actors", "D5", with_views(
    """SELECT user_id, name, email, role FROM users WHERE user_id IN (SELECT user_id FROM audit_logs WHERE user_id IS NOT NULL)
       ORDER BY name, user_id""", "audit_logs", "users"))
def audit_actors(spark, folder):
    return audit.acting_users(D.audit_logs(spark, folder), D.users(spark, folder))


@query("role_counts", "E1 E2", with_views(
    "SELECT role, count(*) AS n, count(*) FILTER (is_active) AS active, count(*) FILTER (email_verified_at IS NULL) AS unverified FROM users GROUP BY role", "users"))
def role_counts(spark, folder):
    return D.users(spark, folder).groupBy("role").agg(
        F.count("*").alias("n"), F.count_if("is_active").alias("active"),
        F.count_if(F.col("email_verified_at").isNull()).alias("unverified"))


@query("user_directory", "B30 C1 C4 G4", with_views(
    """SELECT user_id, name, email, role, array_to_string(list_transform(string_split(name, ' ')[1:2], lambda w: w[1]), '') AS initials
       FROM users WHERE role = 'compliance_officer' AND (name ILIKE '%nation_1%' OR email ILIKE '%nation_1%') ORDER BY name LIMIT 10""", "users"))
def user_directory(spark, folder):
    rows = audit.like_any(D.users(spark, folder).where(F.col("role") == "compliance_officer"), "nation_1", ("name", "email"))
    return ordering.page_of(rows.select("user_id", "name", "email", "role", initials(F.col("name")).alias("initials")),
                            [F.col("name")], 1, 10)


_GONE = f"""role = 'vendor' AND email_verified_at IS NULL AND signature_enrolled_at IS NULL
    AND created_at <= TIMESTAMP '{NOW}' - INTERVAL 60 DAY"""


@query("abandoned_registrations", "C3 C11 C12", with_views(
    f"SELECT user_id, name, {TS.format('created_at')} AS created_at FROM users WHERE {_GONE}", "users"))
def abandoned_registrations(spark, folder):
    rows = accounts.abandoned(D.users(spark, folder), NOW, 60)
    return rows.select("user_id", "name", stamp(F.col("created_at")).alias("created_at"))


@query("users_after_prune", "C12 D6", with_views(
    f"SELECT user_id, role FROM users WHERE NOT coalesce({_GONE}, FALSE)", "users"))
def users_after_prune(spark, folder):
    return accounts.without_abandoned(D.users(spark, folder), NOW, 60).select("user_id", "role")


def _embeddings(spark, folder):
    key = F.col("vec_id")
    return D.table(spark, folder, "embeddings").select(
        key.alias("vendor_id"),
        F.when(key % 10 == 0, "").when(key % 10 == 1, "null").otherwise(F.to_json("embedding")).alias("signature_embedding"))


_STORED = """SELECT vec_id AS vendor_id, CASE WHEN vec_id % 10 = 0 THEN '' WHEN vec_id % 10 = 1 THEN 'null' ELSE 'vector' END AS signature_embedding FROM embeddings"""


@query("unbacked_enrolments", "C3 D2", with_views(
    f"""SELECT v.vendor_id, v.company_name, u.user_id, u.email, {TS.format('u.signature_enrolled_at')} AS signature_enrolled_at
        FROM vendors v JOIN users u USING (user_id) LEFT JOIN stored s USING (vendor_id)
        WHERE u.signature_enrolled_at IS NOT NULL AND (s.signature_embedding IS NULL OR s.signature_embedding = '')""",
    "vendors", "users", extra={"stored": _STORED}))
def unbacked_enrolments(spark, folder):
    rows = accounts.unbacked_enrolments(D.vendors(spark, folder), D.users(spark, folder), _embeddings(spark, folder))
    return rows.withColumn("signature_enrolled_at", stamp(F.col("signature_enrolled_at")))


@query("signature_reference_lookup", "D8", with_views(
    """SELECT v.vendor_id, nullif(nullif(signature_embedding, ''), 'null') IS NOT NULL AS has_reference FROM vendors v LEFT JOIN stored USING (vendor_id)""",
    "vendors", extra={"stored": _STORED}))
def signature_reference_lookup(spark, folder):
    rows = D.vendors(spark, folder).select("vendor_id").join(_embeddings(spark, folder), "vendor_id", "left")
    return rows.select("vendor_id", usable_reference(F.col("signature_embedding")).isNotNull().alias("has_reference"))


#: What the views of vendors lack of a declared profile, as expressions that both
#: engines read.
_DECLARED = {
    "trade_name": "CASE WHEN vendor_id % 19 = 0 THEN repeat('x', 151) ELSE 'Store ' || CAST(vendor_id AS STRING) END",
    "business_permit_number": "CASE WHEN vendor_id % 8 = 0 THEN NULL ELSE 'BP-' || CAST(vendor_id AS STRING) END",
    "nature_of_business": "CASE WHEN vendor_id % 10 = 0 THEN '  ' ELSE company_name END",
    "first_name": "CASE WHEN vendor_id % 12 = 0 THEN '' ELSE business_city END", "middle_name": "CASE WHEN vendor_id % 2 = 0 THEN NULL ELSE repeat('m', CAST(vendor_id % 103 AS INT)) END",
    "last_name": "CASE WHEN vendor_id % 14 = 0 THEN repeat('n', 101) ELSE company_name END", "suffix": "CASE WHEN vendor_id % 15 = 0 THEN repeat('s', 21) ELSE NULL END",
    "date_of_birth": """CASE vendor_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'unknown' WHEN 2 THEN '2024-06-30' WHEN 3 THEN '2024-07-01' ELSE '1980-02-03' END""",
    "gender": "CASE vendor_id % 5 WHEN 0 THEN 'male' WHEN 1 THEN 'female' WHEN 2 THEN 'other' WHEN 3 THEN '' ELSE NULL END",
    "contact_number": "CASE WHEN vendor_id % 16 = 0 THEN repeat('9', 21) ELSE CAST(vendor_id AS STRING) END",
    "government_id_type": "CASE vendor_id % 4 WHEN 0 THEN 'passport' WHEN 1 THEN 'library_card' WHEN 2 THEN 'tin_id' ELSE NULL END",
    "government_id_number": "CASE WHEN vendor_id % 18 = 0 THEN repeat('8', 61) ELSE tin END",
    "home_address": "CASE WHEN vendor_id % 21 = 0 THEN repeat('h', 501) WHEN vendor_id % 22 = 0 THEN NULL ELSE business_street END",
}


def _faults_sql() -> str:
    """The rules in plain words of SQL; no constant is shared with the operator."""
    arms = []
    for name, required, longest in (
            ("company_name", 1, 150), ("trade_name", 0, 150), ("business_entity_type", 1, 0), ("tin", 1, 20), ("dti_registration_number", 0, 50), ("sec_registration_number", 0, 50),
            ("business_permit_number", 1, 50), ("nature_of_business", 1, 150), ("business_street", 1, 255), ("business_barangay", 1, 120), ("business_city", 1, 120), ("business_province", 1, 120),
            ("business_postal_code", 1, 10), ("first_name", 1, 100), ("middle_name", 0, 100), ("last_name", 1, 100), ("suffix", 0, 20), ("date_of_birth", 1, 0), ("gender", 1, 0),
            ("contact_number", 1, 20), ("government_id_type", 1, 0), ("government_id_number", 1, 60), ("home_address", 1, 500)):
        if required:
            arms.append(f"CASE WHEN {name} IS NULL OR trim({name}) = '' THEN '{name}:required' END")
        if longest:
            arms.append(f"CASE WHEN length({name}) > {longest} THEN '{name}:too_long' END")
    arms.append("CASE WHEN business_entity_type NOT IN ('sole_proprietorship', 'partnership', 'corporation') THEN 'business_entity_type:unknown' END")
    arms.append("CASE WHEN length(regexp_replace(tin, '[^0-9]', '', 'g')) NOT IN (9, 12, 13, 14) THEN 'tin:format' END")
    arms.append("CASE WHEN trim(date_of_birth) <> '' AND try_cast(date_of_birth AS DATE) IS NULL THEN 'date_of_birth:not_a_date' END")
    arms.append("CASE WHEN try_cast(date_of_birth AS DATE) >= DATE '2024-07-01' THEN 'date_of_birth:not_before_today' END")
    arms.append("CASE WHEN trim(gender) <> '' AND gender NOT IN ('male', 'female') THEN 'gender:unknown' END")
    arms.append("""CASE WHEN trim(government_id_type) <> '' AND government_id_type NOT IN ('national_id', 'drivers_license', 'passport', 'umid', 'sss_id', 'philhealth_id', 'postal_id', 'prc_id', 'voters_id', 'tin_id')
        THEN 'government_id_type:unknown' END""")
    for name, members in (("dti_registration_number", "'sole_proprietorship'"), ("sec_registration_number", "'partnership', 'corporation'")):
        arms.append(f"CASE WHEN business_entity_type IN ({members}) AND coalesce({name}, '') = '' THEN '{name}:required_for_entity' END")
        arms.append(f"""CASE WHEN coalesce({name}, '') <> '' AND NOT (length(regexp_replace({name}, '[^0-9]', '', 'g')) >= 5
                        AND regexp_matches(trim({name}), '^[A-Za-z0-9/-]+$')) THEN '{name}:format' END""")
    return "array_to_string(list_filter([" + ", ".join(arms) + "], lambda x: x IS NOT NULL), '; ')"


@query("profile_faults", "B9 B10 C14", with_views(
    f"SELECT vendor_id, {_faults_sql()} AS faults FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _DECLARED.items())} FROM vendors)", "vendors"))
def profile_faults(spark, folder):
    rows = D.vendors(spark, folder).withColumns({k: F.expr(v) for k, v in _DECLARED.items()})
    return rows.select("vendor_id", F.array_join(accounts.profile_faults(F.lit("2024-07-01").cast("date")), "; ").alias("faults"))


@query("declared_tin_matches", "D16", with_views(
    """SELECT v.vendor_id, e.doc_key, regexp_replace(v.tin, '[^0-9]', '', 'g') = e.digits AS matches FROM vendors v
       JOIN (SELECT c_custkey AS vendor_id, c_custkey * 10 AS doc_key, lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || '118902' AS digits FROM customer) e USING (vendor_id)""",
    "vendors"))
def declared_tin_matches(spark, folder):
    key = F.col("c_custkey")
    extracted = D.table(spark, folder, "customer").select(
        key.alias("vendor_id"), (key * 10).alias("doc_key"),
        F.concat(F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(" 118 902")).alias("value"))
    return declared_against_extracted(D.vendors(spark, folder), extracted, "tin")


@query("unread_after_mark", "E2 H17", with_views(
    """SELECT user_id, count(*) FILTER (NOT (is_read OR user_id = 8)) AS unread, count(*) AS total FROM notifications GROUP BY user_id""", "notifications"))
def unread_after_mark(spark, folder):
    return accounts.unread_counts(accounts.mark_read(D.notifications(spark, folder), user_id=8))


# --- settings: each customer proposes one setting for its nation ------------
_KEYS = [k for k, *_ in V.SETTINGS]
_DEFAULTS = "(VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(t)}, {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {quoted(d)})"
    for k, t, lo, hi, d in V.SETTINGS) + ") t(key, type, low, high, fallback)"
_PROPOSED = f"""SELECT c_custkey AS proposal_id, c_nationkey, [{', '.join(quoted(k) for k in _KEYS)}][c_custkey % {len(_KEYS)} + 1] AS key,
    CASE WHEN c_custkey % 7 = 0 THEN 'abc' WHEN c_custkey % 7 = 1 THEN '-3' WHEN c_custkey % 7 = 2 THEN '1.5'
         WHEN c_custkey % 7 = 3 THEN '0.3' ELSE CAST(c_custkey % 120 AS VARCHAR) END AS value FROM customer"""


def _proposed(spark, folder):
    key = F.col("c_custkey")
    names = F.array(*[F.lit(k) for k in _KEYS])
    return D.table(spark, folder, "customer").select(
        key.alias("proposal_id"), "c_nationkey", F.get(names, (key % len(_KEYS)).cast("int")).alias("key"),
        F.when(key % 7 == 0, "abc").when(key % 7 == 1, "-3").when(key % 7 == 2, "1.5").when(key % 7 == 3, "0.3")
        .otherwise((key % 120).cast("string")).alias("value"))


@query("setting_faults", "B18 H9", with_views(
    f"""SELECT proposal_id, key, value, array_to_string(list_filter([
        CASE WHEN type = 'int' AND NOT regexp_matches(value, '^\\s*[+-]?[0-9]+\\s*$') THEN 'not_an_integer' END,
        CASE WHEN type = 'float' AND TRY_CAST(value AS DOUBLE) IS NULL THEN 'not_a_number' END,
        CASE WHEN type IN ('int', 'float') AND TRY_CAST(value AS DOUBLE) < low THEN 'below_minimum' END,
        CASE WHEN type IN ('int', 'float') AND TRY_CAST(value AS DOUBLE) > high THEN 'above_maximum' END], lambda x: x IS NOT NULL), '; ') AS faults
        FROM proposed JOIN {_DEFAULTS} USING (key)""", extra={"proposed": _PROPOSED}))
def setting_faults(spark, folder):
    rows = settings.check_updates(_proposed(spark, folder), settings.schema_rows(spark))
    return rows.select("proposal_id", "key", "value", F.array_join("faults", "; ").alias("faults"))


_SETTLED = """SELECT c_nationkey, key, arg_max(value, proposal_id) AS value FROM proposed GROUP BY 1, 2"""
_EFFECTIVE = f"""SELECT n_nationkey AS c_nationkey, d.key, d.type, coalesce(s.value, d.fallback) AS value
    FROM nation, {_DEFAULTS.replace(' t(', ' d(')} LEFT JOIN settled s ON s.c_nationkey = n_nationkey AND s.key = d.key"""


def _effective(spark, folder):
    settled = mutate.latest_by_key(_proposed(spark, folder), ["c_nationkey", "key"], ["proposal_id"])
    scopes = D.table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"))
    return settings.effective(settings.schema_rows(spark), settled, scopes, "c_nationkey")


@query("effective_settings", "H8", with_views("SELECT * FROM effective", extra={
    "proposed": _PROPOSED, "settled": _SETTLED, "effective": _EFFECTIVE}))
def effective_settings(spark, folder):
    return _effective(spark, folder)


@query("weight_sums", "H9", with_views(
    """SELECT c_nationkey, CAST(total AS DOUBLE) AS total, total > 1.0001 AS refused FROM (
         SELECT c_nationkey, count(DISTINCT key) AS weights, sum(CAST(coalesce(TRY_CAST(value AS DOUBLE), 0) AS DECIMAL(20,6))) AS total
         FROM effective WHERE starts_with(key, 'risk_weight_') GROUP BY 1) WHERE weights = 5""",
    extra={"proposed": _PROPOSED, "settled": _SETTLED, "effective": _EFFECTIVE}))
def weight_sums(spark, folder):
    return settings.check_weights(_effective(spark, folder), "c_nationkey")


@query("settings_snapshot_hash", "B19 H8", with_views(
    """SELECT c_nationkey, sha256('{' || string_agg('"' || upper(key) || '":"' || value || '"', ',' ORDER BY upper(key)) || '}') AS settings_hash
       FROM effective GROUP BY 1""", extra={"proposed": _PROPOSED, "settled": _SETTLED, "effective": _EFFECTIVE}))
def settings_snapshot_hash(spark, folder):
    return settings.snapshot(_effective(spark, folder), "c_nationkey").select("c_nationkey", "settings_hash")


def _runtime_sql() -> str:
    arms = []
    for key, low, high, _ in V.RUNTIME_LIMITS:
        number = f"TRY_CAST(max(value) FILTER (key = '{key}') AS DOUBLE)"
        above = "" if high is None else f" OR {number} > {high}"
        arms.append(f"CASE WHEN {number} IS NULL OR {number} < {low}{above} THEN '{key}' END")
    return "array_to_string(list_filter([" + ", ".join(arms) + "], lambda x: x IS NOT NULL), '; ')"


@query("runtime_setting_faults", "H10", with_views(
    f"SELECT c_nationkey, {_runtime_sql()} AS faults FROM effective GROUP BY 1",
    extra={"proposed": _PROPOSED, "settled": _SETTLED, "effective": _EFFECTIVE}))
def runtime_setting_faults(spark, folder):
    rows = settings.snapshot(_effective(spark, folder), "c_nationkey")
    return rows.select("c_nationkey", F.array_join(settings.runtime_faults(F.col("snapshot")), "; ").alias("faults"))


@query("threshold_in_force", "F16", with_views(
    """SELECT c_nationkey, coalesce(TRY_CAST(max(CASE WHEN key = 'stamp_similarity_threshold' THEN value END) AS DOUBLE), 0.9358::DOUBLE, 0.85::DOUBLE) AS stamp,
       coalesce(TRY_CAST(max(CASE WHEN key = 'signature_distance_threshold' THEN value END) AS DOUBLE), 1.243976::DOUBLE) AS signature
       FROM settled GROUP BY 1""", extra={"proposed": _PROPOSED, "settled": _SETTLED}))
def threshold_in_force(spark, folder):
    settled = mutate.latest_by_key(_proposed(spark, folder), ["c_nationkey", "key"], ["proposal_id"])
    own = lambda k: F.max(F.when(F.col("key") == k, F.col("value"))).try_cast("double")
    rows = settled.groupBy("c_nationkey").agg(own("stamp_similarity_threshold").alias("a"), own("signature_distance_threshold").alias("b"))
    none = F.lit(None).cast("double")
    return rows.select("c_nationkey",
                       settings.threshold_in_force(F.col("a"), none, F.lit(0.9358), 0.85).alias("stamp"),
                       settings.threshold_in_force(F.col("b"), none, F.lit(1.243976), None).alias("signature"))


# --- retention ---------------------------------------------------------------
_POLICY_ROWS = "(VALUES " + ", ".join(
    f"({quoted(k)}, {quoted(t)}, {days}::INTEGER, {str(a).upper()}, {'NULL' if ad is None else ad}::INTEGER, {str(d).upper()}, {'NULL' if dd is None else dd}::INTEGER, {str(keep).upper()})"
    for k, t, days, a, ad, d, dd, keep in V.RETENTION) + ") p(key, data_type, retention_days, archive_enabled, archive_after_days, deletion_enabled, deletion_after_days, preserve_unread)"
_SWEEP_NOW = "2024-12-20 00:00:00"


@query("retention_sweep", "H7", with_views(
    f"""SELECT data_type, row_id, age AS age_days, CASE WHEN preserve_unread AND unread THEN 'keep'
          WHEN deletion_enabled AND age >= deletion_after_days THEN 'delete'
          WHEN archive_enabled AND age >= archive_after_days THEN 'archive' ELSE 'keep' END AS verdict FROM (
        SELECT *, CAST(date_diff('day', created_at, TIMESTAMP '{_SWEEP_NOW}') AS INTEGER) AS age FROM (
          SELECT 'notification' AS data_type, notification_id AS row_id, created_at, NOT is_read AS unread FROM notifications
          UNION ALL SELECT 'audit', log_id, created_at, FALSE FROM audit_logs
          UNION ALL SELECT 'submission', submission_id, created_at + INTERVAL 8400 DAY, FALSE FROM submission_rows)
        LEFT JOIN {_POLICY_ROWS} USING (data_type))""", "notifications", "audit_logs", "submission_rows"))
def retention_sweep(spark, folder):
    def rows(frame, kind, key, created, unread):
        return frame.select(F.lit(kind).alias("data_type"), F.col(key).alias("row_id"), created.alias("created_at"), unread.alias("unread"))
    created = F.col("created_at")
    everything = (
        rows(D.notifications(spark, folder), "notification", "notification_id", created, ~F.col("is_read"))
        .unionByName(rows(D.audit_logs(spark, folder), "audit", "log_id", created, F.lit(False)))
        .unionByName(rows(D.submission_rows(spark, folder), "submission", "submission_id",
                          created + F.expr("INTERVAL 8400 DAYS"), F.lit(False))))
    swept = retention.sweep(everything, retention.default_policies(spark), _SWEEP_NOW, unread=F.col("unread"))
    return swept.select("data_type", "row_id", "age_days", "verdict")


@query("retention_policy_faults", "H7 H8", with_views(
    """SELECT proposal_id, array_to_string(list_filter([CASE WHEN days < 1 THEN 'retention_days_below_one' END,
        CASE WHEN arch_on AND arch IS NULL THEN 'archive_days_missing' END, CASE WHEN del_on AND del IS NULL THEN 'deletion_days_missing' END,
        CASE WHEN arch > days THEN 'archive_after_retention' END, CASE WHEN del > days THEN 'deletion_after_retention' END,
        CASE WHEN arch > del THEN 'archive_after_deletion' END], lambda x: x IS NOT NULL), '; ') AS faults
       FROM (SELECT c_custkey AS proposal_id, c_custkey % 400 AS days, c_custkey % 2 = 0 AS arch_on, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey % 300 END AS arch,
             c_custkey % 5 = 0 AS del_on, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 350 END AS del FROM customer)"""))
def retention_policy_faults(spark, folder):
    key = F.col("c_custkey")
    rows = D.table(spark, folder, "customer").select(
        key.alias("proposal_id"), (key % 400).alias("retention_days"), (key % 2 == 0).alias("archive_enabled"),
        F.when(key % 3 != 0, key % 300).alias("archive_after_days"), (key % 5 == 0).alias("deletion_enabled"),
        F.when(key % 7 != 0, key % 350).alias("deletion_after_days"))
    return rows.select("proposal_id", F.array_join(retention.policy_faults(), "; ").alias("faults"))


# --- mutations ---------------------------------------------------------------
@query("latest_attempts", "E39 H1", with_views(
    """SELECT document_id, attempts, processing_status FROM documents""", "documents"))
def latest_attempts(spark, folder):
    """Latest result per document out of all attempts, with the attempt count."""
    return D.documents(spark, folder).select("document_id", "attempts", "processing_status")


@query("attempt_history", "E39", with_views(
    """SELECT submission_id, count(*) AS runs, count(DISTINCT document_id) AS documents, count(*) FILTER (processing_status = 'failed') AS failures,
       arg_max(processing_status, (l_shipdate, l_partkey, l_suppkey, document_id)) AS last_status FROM attempts GROUP BY 1""", "attempts"))
def attempt_history(spark, folder):
    rows = D.attempts(spark, folder)
    return rows.groupBy("submission_id").agg(
        F.count("*").alias("runs"), F.count_distinct("document_id").alias("documents"),
        F.count_if(F.col("processing_status") == "failed").alias("failures"),
        F.max_by("processing_status", F.struct("attempt_order", "document_id")).alias("last_status"))


@query("rerun_upsert", "E22 H1", with_views(
    """SELECT coalesce(b.document_id, d.document_id) AS document_id, CASE WHEN d.document_id IS NOT NULL THEN d.text_score ELSE b.text_score END AS text_score,
       coalesce(d.stamp_score, b.stamp_score) AS stamp_score FROM
       (SELECT document_id, text_score, stamp_score FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY l_shipdate, l_partkey, l_suppkey) AS rn FROM attempts) WHERE rn = 1) b
       FULL JOIN (SELECT document_id, text_score, stamp_score FROM documents WHERE attempts > 1) d ON d.document_id = b.document_id""", "attempts", "documents"))
def rerun_upsert(spark, folder):
    """First attempts, then the rerun; a stamp not read again keeps its value."""
    base = D.attempts(spark, folder).groupBy("document_id").agg(*[F.min_by(c, "attempt_order").alias(c) for c in ("text_score", "stamp_score")])
    delta = D.documents(spark, folder).where(F.col("attempts") > 1).select("document_id", "text_score", "stamp_score")
    return mutate.upsert_keeping(base, delta, ["document_id"], keep=["stamp_score"])


@query("repointed_types", "H4", with_views(
    "SELECT document_id, CASE WHEN document_type_id = 9 THEN 4 ELSE document_type_id END AS document_type_id FROM documents", "documents"))
def repointed_types(spark, folder):
    rows = D.documents(spark, folder).select("document_id", "document_type_id")
    return mutate.rewrite_where(rows, "document_type_id", F.col("document_type_id") == 9, F.lit(4).cast("long"))


_DECISIONS = """SELECT submission_id, -(vendor_id % 25) - 1 AS officer_id, CASE risk_level WHEN 'low' THEN 'approved' WHEN 'high' THEN 'resubmission_requested' ELSE 'escalated' END AS decision,
    CASE WHEN submission_id % 2 = 0 THEN '  Check ' || submission_id || ' ' ELSE '  ' END AS comments, created_at + INTERVAL 2 DAY AS decided_at FROM submissions"""
_DECIDED = """SELECT s.submission_id, s.vendor_id, d.decision AS status, d.officer_id AS reviewed_by, d.decided_at AS reviewed_at,
    nullif(trim(d.comments), '') AS review_comments, s.composite_risk_score, s.risk_level FROM submissions s JOIN decisions d USING (submission_id)
    WHERE s.status = 'pending_review' AND d.decision IN ('approved', 'resubmission_requested')"""


def decided(spark, folder):
    """Submissions that await review with their decisions; they are stored, as both
    sides read them."""
    rows = stored(D.submissions(spark, folder, "pending_review"))
    key = F.col("submission_id")
    decisions = rows.select(
        "submission_id", (-(F.col("vendor_id") % 25) - 1).alias("officer_id"),
        F.when(F.col("risk_level") == "low", "approved").when(F.col("risk_level") == "high", "resubmission_requested")
        .otherwise("escalated").alias("decision"),
        F.when(key % 2 == 0, F.concat(F.lit("  Check "), key, F.lit(" "))).otherwise("  ").alias("comments"),
        (F.col("created_at") + F.expr("INTERVAL 2 DAYS")).alias("decided_at"))
    return mutate.decide(rows, decisions)


@query("officer_decisions", "H5", with_views(
    f"SELECT submission_id, status, reviewed_by, {TS.format('reviewed_at')} AS reviewed_at, review_comments FROM decided",
    "submissions", extra={"decisions": _DECISIONS, "decided": _DECIDED}))
def officer_decisions(spark, folder):
    return decided(spark, folder).select("submission_id", "status", "reviewed_by",
                                          stamp(F.col("reviewed_at")).alias("reviewed_at"), "review_comments")


@query("vendor_state_changes", "H5", with_views(
    """SELECT vendor_id, CASE WHEN d.status = 'approved' THEN 'approved' ELSE 'rejected' END AS status, coalesce(d.score, 0) AS risk_score FROM (
       SELECT vendor_id, arg_max({'status': status, 'score': composite_risk_score}, (reviewed_at, submission_id)) AS d FROM decided GROUP BY 1)""",
    "submissions", extra={"decisions": _DECISIONS, "decided": _DECIDED}))
def vendor_state_changes(spark, folder):
    return mutate.vendor_changes(decided(spark, folder))


@query("decision_events", "A8 H5", with_views(
    f"""SELECT reviewed_by AS user_id, 'submission.' || status AS action, submission_id AS entity_id, vendor_id, risk_level, {TS.format('reviewed_at')} AS created_at FROM decided""",
    "submissions", extra={"decisions": _DECISIONS, "decided": _DECIDED}))
def decision_events(spark, folder):
    rows = mutate.decision_events(decided(spark, folder))
    return rows.select("user_id", "action", "entity_id", "details.vendor_id", "details.risk_level",
                       stamp(F.col("created_at")).alias("created_at"))


@query("vendor_change_diff", "H16", with_views(
    """SELECT vendor_id, column_name AS column, before, after FROM (
         SELECT v.vendor_id, unnest([{'column_name': 'status', 'before': v.status, 'after': n.status},
           {'column_name': 'scored', 'before': CASE WHEN v.risk_score IS NOT NULL THEN 'true' ELSE 'false' END, 'after': 'true'}], recursive := true)
         FROM vendors v JOIN (SELECT vendor_id, CASE WHEN d.status = 'approved' THEN 'approved' ELSE 'rejected' END AS status FROM (
           SELECT vendor_id, arg_max({'status': status}, (reviewed_at, submission_id)) AS d FROM decided GROUP BY 1)) n USING (vendor_id))
       WHERE before IS DISTINCT FROM after""", "submissions", "vendors", extra={"decisions": _DECISIONS, "decided": _DECIDED}))
def vendor_change_diff(spark, folder):
    scored = F.col("risk_score").isNotNull().alias("scored")
    before = D.vendors(spark, folder).select("vendor_id", "status", scored)
    after = mutate.vendor_changes(decided(spark, folder)).select("vendor_id", "status", scored)
    return mutate.changed_columns(before, after, "vendor_id", ["status", "scored"])


_FLAG_LISTS = """SELECT submission_id, list(flag ORDER BY f) AS flags FROM (SELECT submission_id, flag, min(document_id * 1000 + pos) AS f FROM (
    SELECT submission_id, document_id, unnest(flags) AS flag, generate_subscripts(flags, 1) AS pos FROM results) GROUP BY 1, 2) GROUP BY 1"""


@query("processed_notices", "H6 H11", with_views(
    """SELECT user_id, type, body, submission_id FROM (
       SELECT v.user_id, 'processing_complete' AS type, 'Your submission has been processed and is awaiting review.' AS body, submission_id
       FROM ready JOIN vendors v USING (vendor_id) UNION ALL
       SELECT o.user_id, CASE WHEN risk_level = 'high' THEN 'high_risk_alert' WHEN len(flags) > 0 THEN 'document_flagged' ELSE 'general' END,
         CASE WHEN risk_level = 'high' THEN 'High-risk submission detected (score: ' || CAST(round(CAST(composite_risk_score AS DECIMAL(20,9)), 0) AS BIGINT) || '/100) from ' || company_name || '.'
              WHEN len(flags) > 0 THEN 'Submission from ' || company_name || ' has been flagged: ' || array_to_string(flags[1:3], '; ') || '.'
              ELSE 'Submission from ' || company_name || ' is ready for review.' END, submission_id
       FROM ready JOIN vendors v USING (vendor_id), officers o)""", "submissions", "vendors", "officers", "results",
    extra={"flag_lists": _FLAG_LISTS, "ready": """SELECT s.*, coalesce(f.flags, []) AS flags FROM submissions s LEFT JOIN flag_lists f USING (submission_id) WHERE status = 'pending_review'"""}))
def processed_notices(spark, folder):
    """Fan-out of the notices of every submission that awaits review."""
    lists = distinct_in_order(flag_rows(D.results(spark, folder)), ["submission_id"], "flag", ["document_id", "pos"], "_flags")
    ready = D.submissions(spark, folder).where(F.col("status") == "pending_review").join(lists, "submission_id", "left")
    ready = ready.withColumn("flags", F.coalesce("_flags", F.array().cast("array<string>")))
    rows = notices.processed(ready, D.vendors(spark, folder), D.users(spark, folder))
    return rows.select("user_id", "type", "body", "submission_id")


@query("decision_notices", "H6 H11", with_views(
    """SELECT user_id, subject, body, submission_id FROM (
       SELECT v.user_id, CASE WHEN d.status = 'approved' THEN 'Accreditation approved' ELSE 'Resubmission requested' END AS subject,
         CASE WHEN d.status = 'approved' THEN 'Your accreditation has been approved.' ELSE
           'Your submission requires resubmission — please correct the flagged documents and submit again.' || coalesce(' Reason: ' || review_comments, '') END AS body, submission_id
       FROM decided d JOIN vendors v USING (vendor_id) UNION ALL
       SELECT o.user_id, CASE WHEN d.status = 'approved' THEN 'Submission approved' ELSE 'Resubmission requested' END,
         CASE WHEN d.status = 'approved' THEN r.name || ' approved the submission from ' || v.company_name || '.'
              ELSE r.name || ' requested resubmission from ' || v.company_name || '.' || coalesce(' Reason: ' || review_comments, '') END, submission_id
       FROM decided d JOIN vendors v USING (vendor_id) JOIN officers r ON r.user_id = d.reviewed_by, officers o)""",
    "submissions", "vendors", "officers", extra={"decisions": _DECISIONS, "decided": _DECIDED}))
def decision_notices(spark, folder):
    rows = notices.decided(decided(spark, folder), D.vendors(spark, folder), D.users(spark, folder))
    return rows.select("user_id", "subject", "body", "submission_id")


_CANDIDATES = """SELECT d.document_id, d.document_type_id, t.type_name, t.issuer_scope, d.completed_at AS approved_at, d.file_size_bytes % 3 <> 0 AS boxed,
    CASE WHEN v.vendor_id % 5 <> 0 THEN v.business_city END AS detected_city
    FROM documents d JOIN submission_rows s USING (submission_id) JOIN vendors v USING (vendor_id) LEFT JOIN document_types t USING (document_type_id) WHERE s.status = 'approved'"""
_HELD = "SELECT CAST(5 AS BIGINT) AS document_type_id, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS city FROM nation WHERE n_regionkey = 1"


@query("seeded_references", "D6 D7 H2 H3", with_views(
    """SELECT document_type_id, city, CASE WHEN city = '' THEN type_name ELSE city || ' ' || type_name END AS label, document_id AS seeded_from_document_id FROM (
         SELECT *, row_number() OVER (PARTITION BY document_type_id, city ORDER BY approved_at, document_id) AS rn FROM (
           SELECT *, CASE issuer_scope WHEN 'national' THEN '' WHEN 'lgu' THEN nullif(trim(detected_city), '') END AS city FROM candidates WHERE issuer_scope IS NOT NULL AND boxed)
         WHERE city IS NOT NULL) c WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM held h WHERE h.document_type_id = c.document_type_id AND h.city = c.city)""",
    "documents", "submission_rows", "vendors", "document_types", extra={"candidates": _CANDIDATES, "held": _HELD}))
def seeded_references(spark, folder):
    approved = D.submission_rows(spark, folder).where(F.col("status") == "approved").select("submission_id", "vendor_id")
    city = F.when(F.col("vendor_id") % 5 != 0, F.col("business_city")).alias("detected_city")
    places = D.vendors(spark, folder).select("vendor_id", city)
    box = F.when(F.col("file_size_bytes") % 3 != 0, F.array(*[F.lit(v) for v in (1.0, 2.0, 30.0, 40.0)]))
    candidates = (D.documents(spark, folder).join(approved, "submission_id").join(places, "vendor_id")
                  .join(D.document_types(spark), "document_type_id", "left")
                  .select("document_id", "document_type_id", "type_name", "issuer_scope", "detected_city",
                          box.alias("stamp_box"), F.col("completed_at").alias("approved_at")))
    held = D.table(spark, folder, "nation").where(F.col("n_regionkey") == 1).select(
        F.lit(5).cast("long").alias("document_type_id"), F.initcap("n_name").alias("city"))
    return mutate.seed_references(candidates, held).select("document_type_id", "city", "label", "seeded_from_document_id")


# --- model files: the part list is the registry, parts ever shipped are files -
_REGISTRY = """SELECT p_partkey AS model_id, p_name || ' ' || p_partkey AS name, p_type AS purpose, 'models/' || p_brand || '/' || p_partkey AS storage_path,
    ['active', 'standby', 'missing', 'deprecated'][p_size % 4 + 1] AS status, p_size % 5 <> 0 AS loaded, p_size % 2 = 0 AS required FROM part"""
_FILES = """SELECT 'models/' || p_brand || '/' || p_partkey AS storage_path, n * 1000 AS file_size_bytes, modified_at, sha256(CAST(n AS VARCHAR)) AS checksum_sha256
    FROM part JOIN (SELECT l_partkey, count(*) AS n, max(l_shipdate) AS modified_at FROM lineitem GROUP BY 1 HAVING count(*) > 25) ON l_partkey = p_partkey"""


def _registry(spark, folder):
    states = F.array(*[F.lit(s) for s in ("active", "standby", "missing", "deprecated")])
    return D.table(spark, folder, "part").select(
        F.col("p_partkey").alias("model_id"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.col("p_type").alias("purpose"),
        F.concat_ws("/", F.lit("models"), "p_brand", "p_partkey").alias("storage_path"),
        F.get(states, F.col("p_size") % 4).alias("status"), (F.col("p_size") % 5 != 0).alias("loaded"),
        (F.col("p_size") % 2 == 0).alias("required"), F.lit(None).cast("string").alias("checksum_sha256"))


def _files(spark, folder):
    shipped = D.table(spark, folder, "lineitem").groupBy("l_partkey").agg(
        F.count("*").alias("n"), F.max("l_shipdate").alias("modified_at")).where(F.col("n") > 25)
    return D.table(spark, folder, "part").join(shipped, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("/", F.lit("models"), "p_brand", "p_partkey").alias("storage_path"),
        (F.col("n") * 1000).alias("file_size_bytes"), "modified_at", F.sha2(F.col("n").cast("string"), 256).alias("checksum_sha256"))


@query("model_sync", "C11 E6 G2 H14", with_views(
    f"""SELECT model_id, name, purpose, f.storage_path IS NOT NULL AS found, CASE WHEN f.storage_path IS NULL AND status NOT IN ('missing', 'deprecated') THEN 'missing'
        WHEN f.storage_path IS NOT NULL AND status = 'missing' THEN 'standby' ELSE status END AS status, file_size_bytes, {TS.format('modified_at')} AS last_trained_at, checksum_sha256
        FROM registry r LEFT JOIN files f USING (storage_path)""", extra={"registry": _REGISTRY, "files": _FILES}))
def model_sync(spark, folder):
    rows = models.sync(_registry(spark, folder), _files(spark, folder), with_hash=True)
    return rows.select("model_id", "name", "purpose", "found", "status", "file_size_bytes",
                       stamp(F.col("last_trained_at")).alias("last_trained_at"), "checksum_sha256").orderBy("purpose", "name")


@query("model_manifest_report", "H15", with_views(
    """SELECT name, version, coalesce(sha256 = checksum_sha256, FALSE) AS compatible,
       CASE WHEN m.name IS NULL THEN 'entry_missing' WHEN f.storage_path IS NULL THEN 'artifact_missing' WHEN sha256 = checksum_sha256 THEN 'compatible' ELSE 'checksum_mismatch' END AS manifest_status,
       array_to_string(list_filter([CASE WHEN required AND NOT loaded THEN r.name || ':model_not_loaded' END, CASE WHEN required AND m.name IS NULL THEN r.name || ':manifest_entry_missing' END,
         CASE WHEN required AND m.name IS NOT NULL AND NOT coalesce(sha256 = checksum_sha256, FALSE) THEN r.name || ':artifact_incompatible' END], lambda x: x IS NOT NULL), '; ') AS errors
       FROM registry r LEFT JOIN (SELECT p_name || ' ' || p_partkey AS name, 'v' || p_size AS version, sha256(CAST(25 + p_size % 4 AS VARCHAR)) AS sha256 FROM part WHERE p_retailprice < 1900) m USING (name)
       LEFT JOIN files f USING (storage_path)""", extra={"registry": _REGISTRY, "files": _FILES}))
def model_manifest_report(spark, folder):
    manifest = D.table(spark, folder, "part").where(F.col("p_retailprice") < 1900).select(
        F.concat_ws(" ", "p_name", "p_partkey").alias("name"), F.concat(F.lit("v"), F.col("p_size")).alias("version"),
        F.sha2((F.lit(25) + F.col("p_size") % 4).cast("string"), 256).alias("sha256"))
    rows = models.manifest_report(_registry(spark, folder), manifest, _files(spark, folder))
    return rows.withColumn("errors", F.array_join("errors", "; "))
