"""Risk formula and page rollups on the known small cases."""

import pytest
from pyspark.sql import functions as F

from credence.operators import forensics, mutate, review, rollup, risk


@pytest.mark.parametrize("parts, confidence, score, level, override", [
    ((.95, .98, .92, .95, .97), .05, 4.6, "low", False),
    ((.9, .9, .4, .9, 1.0), 0.0, 18.0, "low", False),
    ((1.0, 1.0, None, 1.0, 1.0), 0.0, 15.0, "low", False),
    ((.99, .99, .99, .99, .40), .85, 61.0, "high", True),
    ((1.0, 1.0, 1.0, 1.0, None), 0.0, 0.0, "low", False),
    ((None, None, None, None, None), None, 60.0, "medium", False)])
def test_risk_formula(one, parts, confidence, score, level, override):
    names = ("text", "classification", "signature", "stamp", "tamper")
    columns = {n: F.lit(v).cast("double") for n, v in zip(names, parts)}
    got = one(risk.score_document(columns, F.lit(confidence).cast("double")))
    assert (got.score, got.level, got.hard_override) == (score, level, override)
    listed = [b.component for b in got.breakdown]
    assert ("tamper" in listed) == (parts[4] is not None)
    assert [b.component for b in got.breakdown if b.missing] == [n for n, v in zip(names, parts) if v is None and n != "tamper"]


def test_missing_component_keeps_null_score(one):
    columns = {n: F.lit(None).cast("double") for n in ("text", "classification", "signature", "stamp", "tamper")}
    got = one(risk.score_document(columns, F.lit(None).cast("double")))
    assert all(b.score is None for b in got.breakdown)


@pytest.mark.parametrize("scores, tampered, confidence, hard, passed", [
    ({"ela": .4, "copy_move": .2, "font": 1.0, "cross_reference": 1.0}, 0.4375, .8, True, False),
    ({"font": 0.0, "cross_reference": 0.0}, 1.0, 0.0, False, False),
    ({"ela": .2}, .8, 0.0, False, False),
    ({"copy_move": .1, "metadata": 1.0, "ela": 1.0, "font": 1.0, "cross_reference": 1.0}, .225, .9, True, False),
    ({}, 0.0, 0.0, False, True)])
def test_blend(spark, scores, tampered, confidence, hard, passed):
    names = ("metadata", "ela", "copy_move", "font", "cross_reference")
    flags = {n: F.array(F.lit(n), F.lit("shared")) for n in names}
    got = forensics.blend(spark.range(1), {n: F.lit(scores.get(n)).cast("double") for n in names}, flags).first()
    ran = [n for n in names if n in scores]
    assert got.tamper_flags == (ran[:1] + ["shared"] + ran[1:] if ran else [])
    assert (got.tamper_score, got.tamper_confidence, got.hard_flag, got.tamper_passed) == (tampered, confidence, hard, passed)


def test_classification_rollup_prefers_fakes_then_first_page(spark):
    rows = spark.createDataFrame([
        (1, 1, "completed", None, "bir", .9, .01), (1, 2, "completed", None, "fake", .9, .3), (1, 3, "completed", None, "fake", .9, .3),
        (2, 1, "failed", "error", None, None, None), (2, 2, "skipped", "x", None, None, None),
        (3, 1, "skipped", "x", None, None, None), (3, 2, "completed", None, "bir", .8, .8), (3, 3, "completed", None, "dti", .8, .8)],
        "document_id int, page_index int, status string, reason string, label string, confidence double, authenticity double")
    got = {r.document_id: r.page_index for r in rollup.classification_rollup(rows).collect()}
    assert got == {1: 2, 2: 1, 3: 2}


def test_verification_rollup_tiers(spark):
    rows = spark.createDataFrame([
        (1, 1, "completed", .9), (1, 2, "completed", .4), (1, 3, "completed", .4), (2, 1, "failed", None), (2, 2, "completed", None),
        (3, 1, "skipped", None), (3, 2, "failed", None)], "document_id int, page_index int, status string, similarity double")
    got = {r.document_id: r.page_index for r in rollup.verification_rollup(rows, "similarity").collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_field_merge_and_conflict(spark):
    fields = spark.createDataFrame([
        (1, 1, 0, "tin", "a", True, True, 90.0), (1, 2, 0, "tin", "b", True, True, None), (1, 3, 0, "tin", "c ", True, True, None),
        (1, 1, 1, "trade_name", "same", True, True, 10.0), (1, 2, 1, "trade_name", " same", True, True, 10.0), (1, 1, 2, "ocn", "", True, True, 99.0)],
        "document_id int, page_index int, ord int, field_key string, value string, matched boolean, required boolean, confidence double")
    got = {r.field_key: (r.value, r.conflict, r.page_index) for r in rollup.merged_fields(fields).collect()}
    assert got == {"tin": ("b", True, 2), "trade_name": ("same", False, 1)}
    pages = spark.createDataFrame([(1, i, "completed", 50.0 + i, 2, .5, i == 2, ["x"] if i > 1 else ["y", "x"]) for i in (1, 2, 3)],
                                  "document_id int, page_index int, status string, mean_confidence double, required_total int, text_validation_score double, passes boolean, flags array<string>")
    row = rollup.ocr_rollup(fields, pages).first()
    assert row.flags == ["y", "x", "ocr_field_conflict"] and row.conflicting_fields == ["tin"]
    assert (row.mean_confidence, row.required_matched, row.passes_text_validation) == (53.0, 2, True)


def test_finaliser_barrier(spark):
    subs = spark.createDataFrame([(i, "processing") for i in (1, 2, 3, 4)] + [(5, "approved")], "submission_id int, status string")
    docs = spark.createDataFrame([(1, 10, "completed"), (1, 11, "failed"), (2, 20, "completed"), (2, 21, "ocr"), (3, 30, "failed"), (5, 50, "completed")],
                                 "submission_id int, document_id int, processing_status string")
    results = spark.createDataFrame([(1, 10, 40.0, ["b", "a"]), (1, 11, 70.0, ["a", "c"]), (2, 20, 99.0, ["z"])],
                                    "submission_id int, document_id int, document_risk_score double, flags array<string>")
    got = {r.submission_id: r for r in rollup.finalise_submissions(subs, docs, results).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert (got[1].status, got[1].risk_level, got[1].flags) == ("pending_review", "high", ["b", "a", "c", "Processing failed for 1 document(s)"])
    assert (got[2].status, got[2].composite_risk_score, got[2].flags) == ("processing", None, None)
    assert (got[3].status, got[3].risk_level) == ("pending_review", None)
    assert (got[4].status, got[4].flags) == ("pending_review", [])


def test_upsert_is_idempotent_and_keeps_untouched_columns(spark):
    base = spark.createDataFrame([(1, "Digos", .5, 1), (2, "Makati", .6, 1)], "document_id int, city string, score double, version int")
    delta = spark.createDataFrame([(1, None, None, 2), (3, "Taguig", .9, 2)], "document_id int, city string, score double, version int")
    once = mutate.upsert_keeping(base, delta, ["document_id"], ["city"])
    twice = mutate.upsert_keeping(once, delta, ["document_id"], ["city"])
    wanted = {(1, "Digos", None, 2), (2, "Makati", .6, 1), (3, "Taguig", .9, 2)}
    assert {tuple(r) for r in once.collect()} == wanted == {tuple(r) for r in twice.collect()}
    assert {tuple(r) for r in mutate.upsert(base, delta, ["document_id"], ["version"]).collect()} == {(1, None, None, 2), (2, "Makati", .6, 1), (3, "Taguig", .9, 2)}


def test_warning_chip_and_reasons(one):
    raised = F.array(F.lit("low_confidence"), F.lit("format_mismatch"))
    assert one(review.warning_chip(raised)) == "Format"
    assert one(review.warning_reasons(raised, F.lit(71.5)))[1] == "OCR read this value with low confidence (72%)."
    assert one(review.warning_chip(F.array().cast("array<string>"))) is None


def test_decisions_only_from_review_and_only_allowed(spark):
    subs = spark.createDataFrame([(1, 7, "pending_review", None, None, None, 55.0, "medium"), (2, 7, "approved", None, None, None, 5.0, "low"),
                                  (3, 8, "pending_review", None, None, None, None, None), (4, 9, "pending_review", None, None, None, 1.0, "low")],
                                 "submission_id int, vendor_id int, status string, reviewed_by int, reviewed_at timestamp, review_comments string, composite_risk_score double, risk_level string")
    decisions = spark.sql("SELECT id AS submission_id, 99 AS officer_id, d AS decision, '  ' AS comments, current_timestamp() AS decided_at FROM VALUES (1,'approved'),(2,'approved'),(3,'resubmission_requested'),(4,'rejected') t(id, d)")
    decided = mutate.decide(subs, decisions)
    assert {r.submission_id: r.status for r in decided.collect()} == {1: "approved", 3: "resubmission_requested"}
    assert {tuple(r) for r in mutate.vendor_changes(decided).collect()} == {(7, "approved", 55.0), (8, "rejected", 0.0)}
    assert decided.first().review_comments is None
