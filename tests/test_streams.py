"""Streams over several micro-batches give the batch results, once."""

import os
import random

from pyspark.sql import functions as F

from credence.operators import rollup
from credence.sources import sinks
from credence.streaming import jobs
from credence.streaming.keyed import KeyedTable, adding, newest


def test_scoring_over_batches_equals_batch(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = spark.range(400).select(
        (F.col("id") % 23).alias("document_id"), F.col("id").alias("page_index"), F.when(F.col("id") % 5 == 0, "failed").otherwise("completed").alias("status"),
        F.lit(None).cast("string").alias("reason"), F.when(F.col("id") % 11 == 0, "fake").otherwise("bir").alias("label"),
        F.lit(0.9).alias("confidence"), (F.col("id") * 37 % 100 / 100).alias("authenticity"))
    rows.repartition(6).write.parquet(source)
    stream = jobs.table_stream(spark, source, "part-", rows.schema, files_per_trigger=2)
    root = str(tmp_path / "work")
    jobs.score_pages(stream, root)
    assert jobs.results_table(spark, root).versions() == [0, 1, 2]
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(jobs.scored_documents(spark, root)) == key(rollup.classification_rollup(rows))


STATE = "submission_id long, document_id long, expected int, processing_status string, risk double, version string"


def answers(spark, root):
    return sorted((r.submission_id, r.composite_risk_score, r.revision) for r in jobs.finished_table(spark, root).read().where("finished").collect())


def test_barrier_emits_once_and_answers_later_states(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "work")
    def push(rows):
        spark.createDataFrame(rows, STATE).coalesce(1).write.mode("append").parquet(source)
    def run():
        jobs.finish_submissions(jobs.table_stream(spark, source, "part-", spark.read.parquet(source).schema), root)
        return answers(spark, root)
    push([(1, 10, 2, "completed", 5.0, "1"), (2, 20, 1, "ocr", None, "1"), (3, 30, 1, "failed", None, "1"), (4, 40, 1, "failed", 3.0, "2"), (4, 40, 1, "verifying", None, "1")])
    assert run() == [(3, None, 1), (4, 3.0, 1)]
    push([(1, 11, 2, "failed", 70.0, "1"), (2, 20, 1, "completed", 9.0, "2"), (4, 40, 1, "failed", 3.0, "2")])
    assert run() == [(1, 70.0, 1), (2, 9.0, 1), (3, None, 1), (4, 3.0, 1)]  # the repeated state of 4 emits nothing
    push([(1, 11, 2, "completed", 80.0, "2"), (2, 20, 1, "verifying", None, "3"), (3, 30, 1, "ocr", None, "0")])
    assert run() == [(1, 80.0, 2), (3, None, 1), (4, 3.0, 1)]  # 2 was opened again; the late state of 3 is old
    push([(2, 20, 1, "completed", 9.5, "4"), (5, None, 1, "completed", 1.0, "1")])
    assert run() == [(1, 80.0, 2), (2, 9.5, 3), (3, None, 1), (4, 3.0, 1)]


def test_barrier_in_three_orders_and_batch_sizes(spark, tmp_path):
    rng = random.Random(4)
    events, last = [], {}
    for submission in range(12):
        documents = rng.randint(1, 4)
        for d in range(documents):
            for step, status in enumerate(["verifying", "failed", "completed"][:rng.choice([1, 2, 3, 3, 3])]):
                risk = float(rng.randint(0, 99)) if status != "verifying" else None
                events.append((submission, submission * 10 + d, documents, status, risk, f"{step:03}"))
                last[submission, d] = (status, risk)
    want = []
    for submission in range(12):
        mine = [v for (s, _), v in last.items() if s == submission]
        if all(status != "verifying" for status, _ in mine):
            want.append((submission, max(risk for _, risk in mine)))
    for number, (order, files, batch) in enumerate([(list(events), 6, 1), (events[::-1], 4, 3), (rng.sample(events, len(events)), 5, 2)]):
        source, root = str(tmp_path / f"in{number}"), str(tmp_path / f"work{number}")
        for k in range(files):
            spark.createDataFrame(order[k::files] if number == 2 else order[k * len(order) // files:(k + 1) * len(order) // files], STATE).coalesce(1).write.mode("append").parquet(source)
        jobs.finish_submissions(jobs.table_stream(spark, source, "part-", spark.read.parquet(source).schema, files_per_trigger=batch), root)
        assert [a[:2] for a in answers(spark, root)] == want


def test_activity_counts_late_rows_and_ends_its_state(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "work")
    days = (5, 1, 9, 1, 20)
    for day in days:
        spark.sql(f"SELECT TIMESTAMP'2024-01-{day:02} 07:00:00' AS ts, 'view' AS action").coalesce(1).write.mode("append").parquet(source)
        jobs.count_activity(jobs.table_stream(spark, source, "part-", spark.read.parquet(source).schema, files_per_trigger=1), root, "12 hours")
    rows = jobs.activity_table(spark, root).collect()
    assert sum(r.events for r in rows) == 4 * len(days) and sum(r.late for r in rows) == 8
    assert sorted(r.events for r in rows) == [1] * 12 + [2] * 4
    assert spark.read.parquet(os.path.join(root, "open", "slot=0")).count() == 4  # only the windows of the last day
    stream = jobs.table_stream(spark, source, "part-", spark.read.parquet(source).schema)
    counts = jobs.activity_counts(stream).select(F.col("window.start").alias("w"), "action", "events")
    jobs.run_available(counts, lambda b, n: jobs.write_batch(b, os.path.join(root, "out"), n), str(tmp_path / "plain"), mode="update")
    plain = {(r.w, r.action): r.events for r in jobs.read_batches(spark, os.path.join(root, "out")).collect()}
    assert plain == {(r.w, r.action): r.events for r in rows}


def test_keyed_table_reads_no_history_and_replays_nothing(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k long, v long, seq long", ["k"], buckets=8)
    assert table.read().count() == 0 and table.manifest() == {}
    merge = newest(["k"], ["seq"])
    rows = lambda pairs, seq: spark.createDataFrame([(k, v, seq) for k, v in pairs], "k long, v long, seq long")
    table.apply(rows([(k, k) for k in range(100)], 0), 0, merge)
    first = table.manifest()
    table.apply(rows([(3, 33), (500, 1)], 1), 1, merge)
    after = table.manifest()
    assert sum(first.get(b) != v for b, v in after.items()) <= 2  # other buckets stay where they were
    want = {k: (33 if k == 3 else k) for k in range(100)} | {500: 1}
    read = lambda: {r.k: r.v for r in table.read().collect()}
    assert read() == want
    table.apply(rows([(3, 99)], 9), 1, merge)  # replayed with other rows: nothing happens
    assert read() == want
    spark.createDataFrame([(7, 7, 7)], "k long, v long, seq long").write.parquet(str(tmp_path / "t" / "data" / "v=2" / "_bucket=0"))  # a batch killed before its manifest
    assert read() == want and table.read(0).count() == 100
    table.apply(rows([(3, 1)], 0), 2, merge)  # older than what is stored
    assert read() == want
    table.apply(rows([], 0), 3, merge)
    files = {f for f in table.read().inputFiles()}
    assert len(files) <= 8 and table.vacuum(keep=1) >= 1 and read() == want and table.versions() == [3]
    counts = KeyedTable(spark, str(tmp_path / "c"), "k long, n long", ["k"], buckets=4)
    for batch in range(3):
        counts.apply(spark.range(10).selectExpr("id AS k", "id AS n"), batch, adding(["k"], ["n"]))
    assert {r.k: r.n for r in counts.read().collect()} == {k: 3 * k for k in range(10)}


def test_sinks_append_and_version(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS log_id, TIMESTAMP'2024-01-02 03:04:05' AS created_at, 'a,\"b\"' AS details")
    log = str(tmp_path / "log")
    sinks.append_log(rows, log)
    sinks.append_log(rows, log)
    assert spark.read.parquet(log).count() == 2 and os.path.isdir(os.path.join(log, "day=2024-01-02"))
    first, second = sinks.write_version(rows, str(tmp_path / "t")), sinks.write_version(rows, str(tmp_path / "t"))
    assert first != second and spark.read.parquet(first).count() == 1
    sinks.export_csv(rows, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").option("escape", '"').csv(str(tmp_path / "csv")).first()
    assert back.details == 'a,"b"'


def test_barrier_replays_and_forgets(spark, tmp_path):
    root = str(tmp_path / "work")
    held, finished = jobs.held_table(spark, root), jobs.finished_table(spark, root)
    rows = spark.sql("SELECT 1L AS submission_id, 10L AS document_id, 1 AS expected, '1' AS version, true AS terminal, 5.0D AS risk, TIMESTAMP'2020-01-01 00:00:00' AS seen")
    held.apply(rows, 0, jobs._newest_states(None))  # a batch killed before its answers
    held.apply(rows, 0, jobs._newest_states(None))
    touched = held.written_by(0)
    fresh = jobs.submission_answers(held.read(0, touched), finished.read(buckets=touched))
    assert [tuple(r) for r in fresh.collect()] == [(1, True, 5.0, 1)]
    finished.apply(fresh, 0, newest(finished.keys, ["revision"]))
    assert jobs.submission_answers(held.read(), finished.read()).count() == 0
    held.apply(rows.withColumn("document_id", F.lit(11).cast("long")), 1, jobs._newest_states(1000))
    assert [r.document_id for r in held.read().collect()] == [11]  # the state of 2020 is forgotten


def test_barrier_runs_without_python_rows(spark, tmp_path):
    plan = jobs.submission_answers(jobs.held_table(spark, str(tmp_path)).read(), jobs.finished_table(spark, str(tmp_path)).read())._jdf.queryExecution().optimizedPlan().toString()
    assert not hasattr(jobs, "Barrier") and "Python" not in plan
