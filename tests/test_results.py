"""Result columns of runs, merged at once, one by one and through a keyed table."""

import random

from pyspark.sql import functions as F

from credence.operators import result_columns, review
from credence.streaming.keyed import KeyedTable

RUNS = """k long, version long, signature_bbox array<long>, stamp_bbox array<long>, classification struct<status: string, label: string, confidence: double, authenticity: double>,
    ocr struct<status: string, text: string, confidence: double, score: double, matched: long, expected: long, city: string, pages: int>,
    signature struct<status: string, reason: string, distance: double, threshold: double, match: boolean>,
    stamp struct<status: string, reason: string, similarity: double, match: boolean, tampered: boolean, reference_id: long>, issuer_scope string"""


def one(rng, k, version):
    pick = lambda *v: rng.choice(v)
    state = pick("completed", "skipped", "failed")
    return (k, version, pick(None, [1, 2, 3, version]), pick(None, [9, 9, 9, version]),
            pick(None, (state, pick("bir", None), 0.5, 0.25)), pick(None, (pick("completed", "failed"), f"t{version}", 90.0, 0.5, 3, 6, pick(None, f"City {version}"), pick(0, 1))),
            pick(None, (pick("completed", "skipped"), pick(None, "no_reference_embedding"), pick(0.5, None), 1.2, pick(True, False))),
            pick(None, (pick("completed", "skipped"), pick(None, "unreferenced_logo"), 0.9, pick(True, False), pick(None, True, False), version)), pick(None, "lgu"))


def by_hand(runs):
    """The columns after all runs, run by run in Python."""
    row = {}
    for _, _, signature_box, stamp_box, classification, ocr, signature, stamp, scope in runs:
        flags = []
        row |= {"signature_bbox": signature_box, "stamp_bbox": stamp_box}
        if classification and classification[0] == "completed":
            row |= dict(zip(("classification_label", "classification_confidence", "classification_authenticity"), classification[1:], strict=True))
        if ocr and ocr[0] == "completed" and ocr[7]:
            row |= dict(zip(("ocr_extracted_text", "ocr_confidence", "text_validation_score", "text_fields_matched", "text_fields_expected"), ocr[1:6], strict=True))
            if ocr[6] is not None:
                row["detected_city"] = ocr[6]
        if signature:
            row["signature_detected"] = signature[0] == "completed"
            if row["signature_detected"]:
                row |= {"signature_distance": signature[2], "signature_passed": signature[4], "signature_score": None if signature[2] is None else round(1 - signature[2] / 2.4, 4)}
                flags += ["signature_mismatch"] * (not signature[4])
            else:
                flags += ["no_signature_reference"] * (signature[1] == "no_reference_embedding")
        if stamp:
            ran = stamp[0] == "completed"
            if ran and stamp[4] is not None:
                row["stamp_tampered"] = stamp[4]
            row["stamp_detected"] = ran and stamp[1] is None
            if row["stamp_detected"]:
                row |= {"stamp_similarity": stamp[2], "stamp_score": stamp[2], "stamp_passed": stamp[3], "logo_reference_id": stamp[5]}
                flags += ["stamp_mismatch"] * (not stamp[3])
            else:
                flags += ["no_issuer_logo"] if scope is None else [stamp[1]] if stamp[1] else []
        row["flags"] = flags
    return row


def test_runs_merge_alike_at_once_and_in_batches(spark, tmp_path):
    rng = random.Random(9)
    runs = [one(rng, k, v) for v in range(5) for k in range(12) if k > 2 or v < k + 1]
    want = {k: by_hand([r for r in runs if r[0] == k]) for k in range(12)}
    names = [c for group in result_columns.GROUPS.values() for c in group]
    mapped = result_columns.map_stages(spark.createDataFrame(runs, RUNS), ["k", "version"])
    read = lambda rows: {r.k: {c: r[c] for c in names} for r in rows.collect()}
    full = {k: {c: row.get(c) for c in names} for k, row in want.items()}
    assert read(result_columns.merge_runs(mapped, ["k"], "version")) == full
    table = KeyedTable(spark, str(tmp_path / "results"), mapped.drop("version").schema, ["k"], buckets=4)
    for version in range(5):
        table.apply(mapped.where(F.col("version") == version).drop("version"), version, lambda stored, fresh: result_columns.merge_later(stored, fresh, ["k"]))
    assert read(table.read()) == full
    assert {r.k: r.filled for r in table.read().collect()} == {r.k: r.filled for r in result_columns.merge_runs(mapped, ["k"], "version").collect()}


def test_component_sets(spark):
    documents = spark.createDataFrame([(1, 10, 4), (2, 10, 4), (3, 10, 5), (4, 10, None), (5, 11, 5)], "document_id long, submission_id long, document_type_id long")
    results = spark.createDataFrame([(1, 10, 20.0, 0.9, 0.8, 0.9, 0.5, 0.9, False), (2, 10, 70.0, 0.2, None, None, None, None, False), (3, 10, 70.0, None, 0.9, None, None, 0.1, True)],
                                    "document_id long, submission_id long, document_risk_score double, text_score double, classification_confidence double, signature_score double, signature_distance double, stamp_score double, is_fake boolean")
    types = spark.createDataFrame([(4, "Permit 10"), (5, "permit 9")], "document_type_id long, type_name string")
    rows = review.component_sets(documents, results, types).collect()
    sets = {(r.submission_id, r.ord, r.key, r.label, r.document_id) for r in rows}
    assert sets == {(10, 0, "all", "All", 2), (10, 1, "type-5", "permit 9", 3), (10, 2, "type-4", "Permit 10", 2), (10, 3, "unassigned", "Unassigned", 4), (11, 0, "all", "All", 5), (11, 1, "type-5", "permit 9", 5)}
    assert {r.detail for r in rows if r.document_id in (4, 5)} == {"Stage not yet available."} and len(rows) == 24
    assert {(r.component, r.percent, r.passed, r.detail) for r in rows if r.document_id == 3 and r.component == "classification"} == {("classification", 90, True, "Classified as fake")}
