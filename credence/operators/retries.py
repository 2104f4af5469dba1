"""The retry ledger of document jobs, in batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.operators.sequences import running_sum


def retry_ledger(events: DataFrame) -> DataFrame:
    """What happens after each attempt: done, retry (with its due time) or failed.

    events: document_id, event_id, ts, outcome (ok, retryable, terminal). A
    success or a terminal error ends the job; the third retryable error in a row
    exhausts it; the next event then opens a new job."""
    ends = F.col("outcome") != "retryable"
    daily = events.withColumn("_day", F.to_date("ts"))
    order = ["ts", "event_id"]
    islands = running_sum(daily, ["document_id"], "_day", order, F.when(ends, 1).otherwise(0), "_job", inclusive=False)
    placed = running_sum(islands, ["document_id", "_job"], "_day", order, F.lit(1), "_i")
    attempt = ((F.col("_i") - 1) % V.MAX_TRIES + 1).cast("int")
    exhausted = ~ends & (attempt == V.MAX_TRIES)
    action = F.when(F.col("outcome") == "ok", "done").when(ends | exhausted, "failed").otherwise("retry")
    waits = F.array(*[F.lit(s) for s in V.BACKOFF_SECONDS])
    due = F.when(action == "retry", F.col("ts") + F.make_dt_interval(secs=F.get(waits, attempt - 1).cast("decimal(18,6)")))
    flag = F.when(exhausted, "pipeline_exhausted").when(F.col("outcome") == "terminal", "pipeline_request_failed")
    return placed.select("document_id", "event_id", attempt.alias("attempt"), action.alias("action"), due.alias("due_at"), flag.alias("flag"))
