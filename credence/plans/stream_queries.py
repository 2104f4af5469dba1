"""Registered queries: the streaming jobs run over the tables, and their twins."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from credence.functions.dates import stamp
from credence.operators import retries
from credence.operators.risk import score_document
from credence.plans import domain as D
from credence.plans.page_queries import PAGES, pages
from credence.plans.domain_sql import with_views
from credence.plans.registry import query
from credence.streaming import jobs

_OUTCOMES = "SELECT user_id AS document_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'ok' WHEN 'signup' THEN 'terminal' ELSE 'retryable' END AS outcome FROM events"
_LEDGER = """SELECT document_id, event_id, CAST(attempt AS INTEGER) AS attempt, action, strftime(CASE WHEN action = 'retry' THEN ts + to_seconds([10, 30, 60][attempt]) END, '%Y-%m-%d %H:%M:%S') AS due_at,
    CASE WHEN outcome = 'terminal' THEN 'pipeline_request_failed' WHEN action = 'failed' THEN 'pipeline_exhausted' END AS flag FROM (
    SELECT *, CASE WHEN outcome = 'ok' THEN 'done' WHEN outcome = 'terminal' OR attempt = 3 THEN 'failed' ELSE 'retry' END AS action FROM (
      SELECT *, (row_number() OVER (PARTITION BY document_id, job ORDER BY ts, event_id) - 1) % 3 + 1 AS attempt FROM (
        SELECT *, coalesce(sum(CASE WHEN outcome <> 'retryable' THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS job FROM outcomes)))"""


def _outcomes(events):
    kind = F.col("event_type")
    return events.select(F.col("user_id").alias("document_id"), "event_id", "ts",
                         F.when(kind == "purchase", "ok").when(kind == "signup", "terminal").otherwise("retryable").alias("outcome"))


@query("retry_ledger", "J3", with_views(_LEDGER, extra={"outcomes": _OUTCOMES}))
def retry_ledger(spark, folder):
    rows = retries.retry_ledger(_outcomes(D.table(spark, folder, "events")))
    return rows.withColumn("due_at", stamp(F.col("due_at")))


def _arriving(rows, root, files, name="in"):
    """The rows as a stream of files, dealt by a hash so that every file holds early
    and late ones, a third of them to a batch."""
    source = os.path.join(root, name)
    rows.repartition(files, F.xxhash64(*rows.columns)).write.option("maxRecordsPerFile", 0).parquet(source)
    return jobs.table_stream(rows.sparkSession, source, "part-", rows.schema, files_per_trigger=files // 3)


@query("stream_activity", "C7 J6", """
    SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, action, count(*) AS events FROM (
      SELECT event_type AS action, date_trunc('day', ts) + to_hours(CAST(hour(ts) // 6 * 6 AS INTEGER)) - to_hours(CAST(6 * i AS INTEGER)) AS w FROM events, range(4) g(i)) GROUP BY 1, 2""")
def stream_activity(spark, folder):
    """Events arrive in six files, each over the whole time, so most rows of the later
    batches are behind the watermark; their counts come from the side table."""
    root = jobs.work_folder(spark, "activity")
    events = D.table(spark, folder, "events").select("event_id", "ts", F.col("event_type").alias("action"))
    jobs.count_activity(_arriving(events, root, 6), root, "12 hours")
    return jobs.activity_table(spark, root).select(stamp(F.col("w")).alias("window_start"), "action", "events")


_CLASS = """SELECT document_id, s.status, s.label, s.authenticity, s.page_index FROM (SELECT document_id, coalesce(
      arg_min({'status': class_status, 'label': label, 'authenticity': authenticity, 'page_index': page_index}, (label <> 'fake', authenticity, page_index)) FILTER (class_status = 'completed'),
      arg_min({'status': class_status, 'label': label, 'authenticity': authenticity, 'page_index': page_index}, page_index)) AS s FROM pages_ GROUP BY 1)"""


@query("stream_scoring", "J1 J5", with_views(_CLASS, "line_facts", extra=PAGES))
def stream_scoring(spark, folder):
    """Pages arrive as line items; document results equal the batch rollup."""
    root = jobs.work_folder(spark, "scoring")
    items = jobs.table_stream(spark, folder, "lineitem", D.table(spark, folder, "lineitem").schema)
    rows = pages(spark, folder, items).select("document_id", "page_index", F.col("class_status").alias("status"),
                                              F.col("class_reason").alias("reason"), "label", "confidence", "authenticity")
    jobs.score_pages(rows, root)
    return jobs.scored_documents(spark, root).select("document_id", "status", "label", "authenticity", "page_index")


@query("stream_barrier", "J4", with_views("""
    SELECT d.submission_id, max(r.document_risk_score) AS composite_risk_score FROM documents d LEFT JOIN results r USING (document_id)
    GROUP BY 1 HAVING bool_and(d.processing_status IN ('completed', 'failed'))""", "documents", "results"))
def stream_barrier(spark, folder):
    """Every attempt brings two states of its document, verifying and then how it
    ended, and a retry replaces both. They arrive in any order."""
    root = jobs.work_folder(spark, "barrier")
    attempts = D.attempts(spark, folder)
    expected = attempts.groupBy("submission_id").agg(F.count_distinct("document_id").cast("int").alias("expected"))
    risk = score_document(D.component_columns(), F.col("tamper_confidence"))["score"]
    at = F.lpad(F.col("attempt_order").cast("string"), 38, "0")
    step = lambda state, number, score: F.struct(F.concat(at, F.lit(number)).alias("version"), state.alias("processing_status"), score.alias("risk"))
    states = attempts.join(expected, "submission_id").select("submission_id", "document_id", "expected", F.inline(F.array(
        step(F.lit("verifying"), "0", F.lit(None).cast("double")), step(F.col("processing_status"), "1", F.when(F.col("processing_status") != "verifying", risk)))))
    jobs.finish_submissions(_arriving(states, root, 48), root)
    return jobs.finished_submissions(spark, root).select("submission_id", "composite_risk_score")
