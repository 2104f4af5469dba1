"""Registered queries: receipts, sync counts, policies in force and form upkeep."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.dates import stamp
from credence.operators import accounts, layout, models, notices, retention, rollup
from credence.plans import domain as D
from credence.plans import operations_queries as O
from credence.plans.domain_sql import with_views
from credence.plans.registry import QUERIES, STATEMENTS, query


@query("receipt_notices", "H6", with_views(
    """SELECT v.user_id, 'submission_received' AS type, 'Submission received' AS subject, 'Your submission has been received and is being processed.' AS body, submission_id
       FROM submission_rows JOIN vendors v USING (vendor_id)""", "submission_rows", "vendors"))
def receipt_notices(spark, folder):
    return notices.received(D.submission_rows(spark, folder), D.vendors(spark, folder))


@query("model_sync_counts", "E6 H14", f"""SELECT count(*) AS scanned, count(*) FILTER (found) AS found, count(*) FILTER (NOT found) AS missing, max(last_trained_at) AS last_change FROM ({STATEMENTS['model_sync']})""")
def model_sync_counts(spark, folder):
    """What one look at the model files came to, and the latest change it saw."""
    rows = QUERIES["model_sync"](spark, folder)
    return models.sync_counts(rows, F.max("last_trained_at").alias("last_change"))


def _policies_sql() -> str:
    text = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(text(x) for x in row) + ")" for row in V.RETENTION) + ") t(key, data_type, retention_days, archive_enabled, archive_after_days, deletion_enabled, deletion_after_days, preserve_unread)"


@query("retention_in_force", "H8", with_views(
    """SELECT d.key, data_type, coalesce(n, retention_days) AS retention_days, archive_enabled, archive_after_days, deletion_enabled, coalesce(n // 2, deletion_after_days) AS deletion_after_days, preserve_unread
       FROM defaults d LEFT JOIN (SELECT CASE WHEN event_type = 'view' THEN 'audit' WHEN event_type = 'click' THEN 'notification' ELSE 'other' END AS kind, CAST(count(*) % 900 + 10 AS INTEGER) AS n FROM events GROUP BY 1) p ON contains(lower(d.data_type), p.kind)""",
    extra={"defaults": _policies_sql()}))
def retention_in_force(spark, folder):
    """Stored values of some policies over the defaults of all."""
    kind = F.when(F.col("event_type") == "view", "audit").when(F.col("event_type") == "click", "notification").otherwise("other")
    stored = D.table(spark, folder, "events").groupBy(kind.alias("kind")).agg((F.count("*") % 900 + 10).cast("int").alias("n"))
    defaults = retention.default_policies(spark)
    empty = lambda kind: F.lit(None).cast(kind)
    persisted = defaults.join(stored, F.contains(F.lower("data_type"), F.col("kind"))).select(
        "key", F.col("n").alias("retention_days"), empty("boolean").alias("archive_enabled"), empty("int").alias("archive_after_days"), empty("boolean").alias("deletion_enabled"),
        F.expr("CAST(n div 2 AS INT)").alias("deletion_after_days"), empty("boolean").alias("preserve_unread"))
    return retention.overlay(defaults, persisted)


@query("template_boxes", "B23", with_views(
    """SELECT supp, x / 1600.0::DOUBLE AS x, y / 2000.0::DOUBLE AS y, (r - x) / 1600.0::DOUBLE AS w, (b - y) / 2000.0::DOUBLE AS h FROM (
         SELECT l_suppkey AS supp, min(l_partkey % 1500) AS x, min(l_orderkey % 1900) AS y, max(l_partkey % 1500 + l_linenumber * 10) AS r, max(l_orderkey % 1900 + CAST(l_quantity AS BIGINT)) AS b FROM lineitem GROUP BY 1)"""))
def template_boxes(spark, folder):
    """One box around all boxes of a supplier's page, as fractions of the page."""
    boxes = D.table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("supp"), (F.col("l_partkey") % 1500).alias("x"), (F.col("l_orderkey") % 1900).alias("y"), (F.col("l_linenumber") * 10).alias("w"), D.whole("l_quantity").alias("h"))
    return layout.to_fraction(layout.union_boxes(boxes, ["supp"]), 1600.0, 2000.0)


@query("missing_box_keys", "L13", with_views(
    """SELECT c_custkey AS template, k AS box_key FROM customer, range(7) g(k) WHERE (c_custkey, k) NOT IN (SELECT o_custkey, o_orderkey % 7 FROM orders)"""))
def missing_box_keys(spark, folder):
    boxes = D.table(spark, folder, "orders").select(F.col("o_custkey").alias("template"), (F.col("o_orderkey") % 7).alias("box_key"))
    wanted = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("template"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("box_key"))
    return layout.missing_keys(boxes, wanted, ["template", "box_key"])


@query("joined_page_texts", "E15", with_views(
    """SELECT doc_id // 4 AS document_id, string_agg(text, chr(10) || chr(10) ORDER BY doc_id % 4) AS text FROM documents WHERE text <> '' GROUP BY 1"""))
def joined_page_texts(spark, folder):
    """Given texts as the pages of documents of four."""
    pages = D.table(spark, folder, "documents").select(F.expr("doc_id div 4").alias("document_id"), (F.col("doc_id") % 4).alias("page_index"),
                                                      F.lit("completed").alias("status"), "text")
    return rollup.merged_text(pages)


@query("users_after_clearing", "H17", with_views(
    f"""SELECT user_id, {O.TS.format("CASE WHEN user_id NOT IN (SELECT user_id FROM (" + STATEMENTS["unbacked_enrolments"] + ")) THEN signature_enrolled_at END")} AS signature_enrolled_at FROM users""", "users"))
def users_after_clearing(spark, folder):
    """The users once enrolments that no vector supports are withdrawn."""
    unbacked = QUERIES["unbacked_enrolments"](spark, folder).select("user_id").distinct()
    return accounts.clear_enrolments(D.users(spark, folder), unbacked).select("user_id", stamp(F.col("signature_enrolled_at")).alias("signature_enrolled_at"))
