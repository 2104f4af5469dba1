"""The document queue as Structured Streaming.

Sinks are folders per micro-batch, overwritten when a batch is replayed, or keyed
tables whose manifest names the batches it holds; a restart after a lost executor or
driver repeats no effect."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence.operators import rollup
from credence.session import ensure_checkpoint_dir
from credence.streaming.keyed import KeyedTable, Merge, newest, replacing


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex}")


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet table read as a stream; new files are new data."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", f"{name}*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def write_batch(rows: DataFrame, root: str, batch_id: int) -> None:
    """Replace the output of one micro-batch."""
    rows.write.mode("overwrite").parquet(os.path.join(root, f"batch={batch_id}"))


def read_batches(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """All micro-batch outputs with their batch number."""
    reader = spark.read.option("basePath", root)
    return (reader if schema is None else reader.schema(schema)).parquet(root)


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], root: str, mode: str = "append") -> None:
    """Process all available data in micro-batches and stop."""
    (stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", os.path.join(root, "_progress"))
     .trigger(availableNow=True).start().awaitTermination())


# --- scoring -------------------------------------------------------------------
RESULT = "document_id long, status string, reason string, label string, confidence double, authenticity double, page_index long"


def results_table(spark: SparkSession, root: str) -> KeyedTable:
    """The current result of each document."""
    return KeyedTable(spark, os.path.join(root, "results"), RESULT, ["document_id"])


def score_pages(stream: DataFrame, root: str) -> None:
    """Document class results kept up to date as pages arrive: the batch job's own
    rollup, held as one running aggregate per document. A batch touches only the
    documents it brings, in whatever order they come, and rewrites their buckets."""
    table = results_table(stream.sparkSession, root)
    run_available(rollup.classification_rollup(stream), lambda batch, n: table.apply(batch, n, replacing(table.keys)), root, mode="update")


def scored_documents(spark: SparkSession, root: str) -> DataFrame:
    """Latest result of each document."""
    return results_table(spark, root).read()


# --- submission barrier -----------------------------------------------------------
FINISHED = "submission_id long, finished boolean, composite_risk_score double, revision int"
#: A document of a submission in its newest state. A row without a document only says how many to expect.
HELD = "submission_id long, document_id long, expected int, version string, terminal boolean, risk double, seen timestamp"
BUCKETS = 64


def held_table(spark: SparkSession, root: str) -> KeyedTable:
    """The newest state of each document, by submission."""
    return KeyedTable(spark, os.path.join(root, "held"), HELD, ["submission_id"], BUCKETS)


def finished_table(spark: SparkSession, root: str) -> KeyedTable:
    """The latest answer on each submission that ever was finished, in the same buckets."""
    return KeyedTable(spark, os.path.join(root, "finished"), FINISHED, ["submission_id"], BUCKETS)


def _newest_states(keep_ms: int | None) -> Merge:
    """Of a document the state of the highest version stays; states of one version stand
    by being terminal, then risk. Submissions not seen for ``keep_ms`` are forgotten."""
    def merge(stored: DataFrame, fresh: DataFrame) -> DataFrame:
        if keep_ms is not None:
            last = stored.groupBy("submission_id").agg(F.max("seen").alias("_last"))
            alive = F.unix_millis("_last") + keep_ms >= F.unix_millis(F.current_timestamp())
            stored = stored.join(last.where(alive).select("submission_id"), "submission_id", "left_semi")
        newest_state = F.max(F.struct("version", "terminal", "risk")).alias("_state")
        rows = stored.unionByName(fresh).groupBy("submission_id", "document_id").agg(F.max("expected").alias("expected"), newest_state, F.max("seen").alias("seen"))
        return rows.select("*", "_state.*").drop("_state")
    return merge


def submission_answers(held: DataFrame, before: DataFrame) -> DataFrame:
    """What changed for the submissions of ``held`` against the answers of ``before``: a
    row when a submission is finished for the first time (revision 1), and again only if
    a later state changes that answer."""
    known, terminal = F.col("document_id").isNotNull(), F.col("terminal")
    totals = held.groupBy("submission_id").agg(
        F.max("expected").alias("_expected"), F.count_if(known).alias("_known"), F.count_if(known & terminal).alias("_done"), F.max(F.when(known, F.col("risk"))).alias("_risk"))
    now = (F.col("_expected") > 0) & (F.col("_done") >= F.col("_expected")) & (F.col("_done") == F.col("_known"))
    fresh = totals.select("submission_id", F.coalesce(now, F.lit(False)).alias("_now"), F.when(now, F.col("_risk")).alias("_score"))
    same = (F.col("_now") == F.coalesce("finished", F.lit(False))) & F.col("_score").eqNullSafe(F.col("composite_risk_score"))
    return fresh.join(before, "submission_id", "left").where(~same).select(
        "submission_id", F.col("_now").alias("finished"), F.col("_score").alias("composite_risk_score"), (F.coalesce("revision", F.lit(0)) + 1).alias("revision"))


def finish_submissions(stream: DataFrame, root: str, keep_ms: int | None = None) -> None:
    """Emit each submission when all its documents are terminal.

    stream: submission_id, document_id, expected, processing_status, risk, version (a
    string that sorts by time). Documents are held in a keyed table: a batch reads and
    rewrites the buckets of the submissions it brings, never the history. The order of
    arrival does not matter: of a document the state of the highest version counts, also
    within a batch. Whoever is late changes the answer by a new revision, whoever reopens
    it takes it back (finished false). With ``keep_ms`` a batch forgets submissions of its
    buckets that were not seen for that long; their answers stay. A batch that was killed
    between its two tables is answered from the first when it is replayed."""
    spark = stream.sparkSession
    states = stream.select(
        "submission_id", "document_id", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("version", F.lit("")).alias("version"),
        F.coalesce(F.col("processing_status").isin(*rollup.TERMINAL), F.lit(False)).alias("terminal"), "risk", F.current_timestamp().alias("seen"))
    held, finished = held_table(spark, root), finished_table(spark, root)

    def each(batch: DataFrame, n: int) -> None:
        held.apply(batch, n, _newest_states(keep_ms))
        touched = held.written_by(n)
        finished.apply(submission_answers(held.read(n, touched), finished.read(buckets=touched)), n, newest(finished.keys, ["revision"]))

    run_available(states, each, root)


def finished_submissions(spark: SparkSession, root: str) -> DataFrame:
    """Submissions that are finished now."""
    return finished_table(spark, root).read().where("finished")


# --- activity ------------------------------------------------------------------------
def activity_counts(stream: DataFrame, window: str = "24 hours", slide: str = "6 hours", late: str | None = None) -> DataFrame:
    """Events per action in sliding windows. All rows count, in any order; a caller
    that must bound the state names how ``late`` a row may come."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    held = timed if late is None else timed.withWatermark("ts", late)
    return held.groupBy(F.window("ts", window, slide), "action").agg(F.count("*").alias("events"))


ACTIVITY = "w timestamp, ends timestamp, action string, events long"


def _at(root: str, *parts: str) -> str:
    return os.path.join(root, *parts)


def count_activity(stream: DataFrame, root: str, late: str, window: str = "24 hours", slide: str = "6 hours") -> None:
    """Events per action in sliding windows, with state that ends.

    stream: ts, action. The watermark of a batch is the latest ``ts`` of the batches
    before it less ``late``. Windows that end after it are open: a batch rewrites only
    these, in the one of two places that the batch before did not write. Windows that
    the new watermark passes are closed, once, into an append-only table. A row that
    comes for a closed window is not dropped but counted in a side table. Every batch
    writes folders named by its number, so a replay repeats no effect. Counts leave
    the tasks aggregated, so an action with most of the rows is one sum."""
    spark = stream.sparkSession

    def each(batch: DataFrame, n: int) -> None:
        timed = batch.withColumn("ts", F.col("ts").cast("timestamp"))
        counts = timed.groupBy(F.window("ts", window, slide), "action").agg(F.count("*").alias("events"), F.max("ts").alias("_last"))
        fresh_at = _at(root, "fresh")
        counts.select(F.col("window.start").alias("w"), F.col("window.end").alias("ends"), "action", "events", "_last").write.mode("overwrite").parquet(fresh_at)
        fresh = spark.read.schema(ACTIVITY + ", _last timestamp").parquet(fresh_at)
        before = spark.read.schema("high timestamp").parquet(_at(root, "marks", f"batch={n - 1}")).first().high if n else None
        marks = fresh.agg(F.max("_last").alias("high")).select(F.greatest("high", F.lit(before).cast("timestamp")).alias("high"))
        marks.coalesce(1).write.mode("overwrite").parquet(_at(root, "marks", f"batch={n}"))
        high = spark.read.schema("high timestamp").parquet(_at(root, "marks", f"batch={n}")).first().high
        passed = lambda mark: F.coalesce(F.col("ends") <= F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {late}"), F.lit(False))
        rows = fresh.drop("_last")
        write_batch(rows.where(passed(before)), _at(root, "late"), n)
        current = rows.where(~passed(before))
        if n:
            current = current.unionByName(spark.read.schema(ACTIVITY).parquet(_at(root, "open", f"slot={(n - 1) % 2}")))
        summed = current.groupBy("w", "ends", "action").agg(F.sum("events").alias("events"))
        summed.where(~passed(high)).write.mode("overwrite").parquet(_at(root, "open", f"slot={n % 2}"))
        write_batch(summed.where(passed(high)), _at(root, "closed"), n)

    run_available(stream, each, root)


def activity_table(spark: SparkSession, root: str) -> DataFrame:
    """w, ends, action, events and late (how many of them came for a closed window)."""
    marks = read_batches(spark, _at(root, "marks"), T.StructType([T.StructField("high", T.TimestampType()), T.StructField("batch", T.IntegerType())]))
    last = marks.agg(F.max("batch").alias("n")).first().n
    part = lambda path, late: spark.read.schema(ACTIVITY).parquet(path).select("w", "ends", "action", "events").withColumn("late", F.col("events") if late else F.lit(0))
    rows = part(_at(root, "closed"), False).unionByName(part(_at(root, "open", f"slot={last % 2}"), False)).unionByName(part(_at(root, "late"), True))
    return rows.groupBy("w", "ends", "action").agg(F.sum("events").alias("events"), F.sum("late").alias("late"))
