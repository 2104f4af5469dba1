"""Page -> document -> submission rollups.

All rollups are combining aggregations (min_by / max_by / bool_and ...), so a
document or submission holding a large share of the rows is reduced map-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import compact, flag_if
from credence.functions.numbers import round_to
from credence.operators.review import distinct_in_order, flag_rows
from credence.operators.risk import risk_band

TERMINAL = ("completed", "failed")


def finalise_submissions(submissions: DataFrame, documents: DataFrame, results: DataFrame,
                         high: float = V.HIGH_RISK, medium: float = V.MEDIUM_RISK) -> DataFrame:
    """Processing submissions whose documents are all terminal move to review
    with the highest document score; the others stay as they are."""
    open_ones = submissions.where(F.col("status") == "processing").select("submission_id")
    state = F.col("processing_status")
    progress = documents.groupBy("submission_id").agg(
        F.bool_and(state.isin(*TERMINAL)).alias("_ready"), F.count_if(state == "failed").alias("_failed"))
    scores = results.groupBy("submission_id").agg(F.max("document_risk_score").alias("_top"))
    raised = distinct_in_order(flag_rows(results), ["submission_id"], "flag", ["document_id", "pos"], "_flags")
    ready = F.coalesce("_ready", F.lit(True))
    failed = F.when(F.col("_failed") > 0, F.array(F.concat(
        F.lit("Processing failed for "), F.col("_failed").cast("string"), F.lit(" document(s)"))))
    none = F.array().cast("array<string>")
    top = F.when(ready, F.col("_top"))
    return (open_ones.join(progress, "submission_id", "left").join(scores, "submission_id", "left")
            .join(raised, "submission_id", "left")
            .select("submission_id", F.when(ready, "pending_review").otherwise("processing").alias("status"),
                    top.alias("composite_risk_score"), risk_band(top, high, medium).alias("risk_level"),
                    F.when(ready, F.concat(F.coalesce("_flags", none), F.coalesce(failed, none))).alias("flags")))


# --- page -> document ---------------------------------------------------------
def _where(condition, order):
    """An ordering that only rows satisfying the condition take part in."""
    return F.when(condition, order)


def classification_rollup(pages: DataFrame) -> DataFrame:
    """Worst completed page: fakes first, then the lowest authenticity, then the
    first page; without a completed page the first page's stage stands.

    pages: document_id, page_index, status, reason, label, confidence, authenticity."""
    stage = F.struct("status", "reason", "label", "confidence", "authenticity", "page_index")
    worst = F.struct((F.col("label") != "fake").alias("a"), F.coalesce("authenticity", F.lit(1.0)).alias("b"), "page_index")
    picked = F.coalesce(F.min_by(stage, _where(F.col("status") == "completed", worst)), F.min_by(stage, "page_index"))
    return pages.groupBy("document_id").agg(picked.alias("s")).select("document_id", "s.*")


def verification_rollup(pages: DataFrame, score: str) -> DataFrame:
    """Lowest score; else the first completed page; else the first page."""
    others = [c for c in pages.columns if c != "document_id"]
    stage, done = F.struct(*others), F.col("status") == "completed"
    scored = _where(done & F.col(score).isNotNull(), F.struct(score, "page_index"))
    picked = F.coalesce(F.min_by(stage, scored), F.min_by(stage, _where(done, F.col("page_index"))), F.min_by(stage, "page_index"))
    return pages.groupBy("document_id").agg(picked.alias("s")).select("document_id", "s.*")


def tamper_rollup(pages: DataFrame) -> DataFrame:
    """Highest score with its technique detail, plus the extremes over all
    completed pages; a missing verdict counts as not passed and not hard.

    pages: document_id, page_index, status, tamper_score, tamper_authenticity,
    tamper_confidence, hard_flag, tamper_passed, flags, detail."""
    done = F.col("status") == "completed"
    score = F.coalesce("tamper_score", F.lit(0.0))
    only = lambda c: F.when(done, c)
    worst = _where(done, F.struct(score, -F.col("page_index")))
    figures = pages.groupBy("document_id").agg(
        F.max_by("detail", worst).alias("detail"), F.max_by("page_index", worst).alias("worst_page"),
        F.max(only(score)).alias("tamper_score"), F.min(only(F.coalesce("tamper_authenticity", F.lit(1.0)))).alias("tamper_authenticity"),
        F.max(only(F.coalesce("tamper_confidence", F.lit(0.0)))).alias("tamper_confidence"),
        F.bool_or(only(F.coalesce("hard_flag", F.lit(False)))).alias("hard_flag"),
        F.bool_and(only(F.coalesce("tamper_passed", F.lit(False)))).alias("tamper_passed"),
        F.count_if(done).alias("page_count"))
    raised = pages.where(done).select("document_id", "page_index", F.posexplode("flags").alias("pos", "flag"))
    flags = distinct_in_order(raised, ["document_id"], "flag", ["page_index", "pos"], "flags")
    return figures.join(flags, "document_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))


def detection_rows(pages: DataFrame) -> DataFrame:
    """All detections of documents with a completed page, page index attached.
    Kept in long form: a document may hold any number of boxes."""
    live = pages.where(F.col("status") == "completed").select("document_id")
    rows = pages.select("document_id", "page_index", F.posexplode("detections").alias("pos", "d"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.DETECTION_ALIASES.items() for x in kv]), F.col("d.label")), F.col("d.label"))
    return rows.join(live, "document_id", "left_semi").select(
        "document_id", "page_index", "pos", label.alias("label"), F.col("d.confidence").alias("confidence"), F.col("d.box").alias("box"))


def detection_flags(pages: DataFrame) -> DataFrame:
    """Distinct detection flags per document in first-seen order."""
    raised = pages.select("document_id", "page_index", F.posexplode("flags").alias("pos", "flag"))
    return distinct_in_order(raised, ["document_id"], "flag", ["page_index", "pos"], "flags")


def missing_labels(found: Column, known: list[str] | None = None) -> Column:
    """no_<label>_detected for every detectable label the model knows but did not find."""
    expected = F.array(*[F.lit(x) for x in V.DETECTABLE if known is None or x in known])
    return F.transform(F.array_except(expected, found), lambda x: F.concat(F.lit("no_"), x, F.lit("_detected")))


def best_boxes(detections: DataFrame, keys: list[str], labels: tuple[str, ...]) -> DataFrame:
    """The most confident box among the labels; the first one wins a tie."""
    first = [-F.col(c) for c in ("page_index", "pos")]
    return detections.where(F.col("label").isin(*labels)).groupBy(*keys).agg(
        F.max_by(F.struct("label", "confidence", "box", "page_index"), F.struct("confidence", *first)).alias("b")).select(*keys, "b.*")


def merged_fields(fields: DataFrame) -> DataFrame:
    """Best reading per field over the completed pages: highest confidence, an
    unknown confidence ranks above all, the earliest page wins a tie. Also tells
    whether the pages disagree and where the field was first seen.

    fields: document_id, page_index, ord, field_key, value, matched, required, confidence."""
    read = fields.where(F.col("matched") & F.col("value").isNotNull() & (F.col("value") != ""))
    rank = F.struct(F.coalesce("confidence", F.lit(101.0)), -F.col("page_index"))
    picked = F.max_by(F.struct("value", "confidence", "required", "page_index"), rank)
    trimmed = F.trim("value")
    return read.groupBy("document_id", "field_key").agg(
        picked.alias("f"), (F.min(trimmed) != F.max(trimmed)).alias("conflict"),
        F.min(F.struct("page_index", "ord")).alias("first_seen")).select("document_id", "field_key", "f.*", "conflict", "first_seen")


def ocr_rollup(fields: DataFrame, pages: DataFrame) -> DataFrame:
    """Document reading quality: best page figures, count of required fields
    selected, distinct flags plus ocr_field_conflict, conflicting fields in
    first-seen order. The score is the best page's, not recomputed.

    pages: document_id, page_index, status, mean_confidence, required_total,
    text_validation_score, passes, flags."""
    done = pages.where(F.col("status") == "completed")
    merged = merged_fields(fields.join(done.select("document_id", "page_index"), ["document_id", "page_index"], "left_semi"))
    figures = done.groupBy("document_id").agg(
        F.count("*").alias("page_count"), F.max("mean_confidence").alias("mean_confidence"), F.max("required_total").alias("required_total"),
        F.max("text_validation_score").alias("text_validation_score"), F.bool_or("passes").alias("passes_text_validation"))
    chosen = merged.groupBy("document_id").agg(
        F.count_if("required").alias("required_matched"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("conflict"), F.struct("first_seen", "field_key")))),
                    lambda x: x["field_key"]).alias("conflicting_fields"))
    raised = done.select("document_id", "page_index", F.posexplode("flags").alias("pos", "flag"))
    flags = distinct_in_order(raised, ["document_id"], "flag", ["page_index", "pos"], "_flags")
    none = F.array().cast("array<string>")
    conflicts = F.coalesce("conflicting_fields", none)
    return (figures.join(chosen, "document_id", "left").join(flags, "document_id", "left")
            .select("document_id", "page_count", round_to(F.col("mean_confidence"), 1).alias("mean_confidence"), "required_total",
                    F.coalesce("required_matched", F.lit(0)).alias("required_matched"), "text_validation_score", "passes_text_validation",
                    F.array_distinct(F.concat(F.coalesce("_flags", none), F.when(
                        F.size(conflicts) > 0, F.array(F.lit("ocr_field_conflict"))).otherwise(none))).alias("flags"),
                    conflicts.alias("conflicting_fields")))


def merged_text(pages: DataFrame) -> DataFrame:
    """Page texts of a document joined by a blank line. A document's pages are
    limited at intake (``max_pdf_pages``), which bounds the joined value."""
    texts = pages.where((F.col("status") == "completed") & (F.col("text") != ""))
    ordered = F.array_sort(F.collect_list(F.struct("page_index", "text")))
    return texts.groupBy("document_id").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n").alias("text"))


def classification_flags(label: Column, passed: Column, declared: Column, known: list[str]) -> Column:
    """Flags of one page's class: fake, else a confident mismatch with a declared
    type the model knows; low confidence on its own."""
    fake = label == "fake"
    mismatch = ~fake & passed & declared.isin(*known) & (label != declared)
    return compact(flag_if(~passed, "low_classification_confidence"), flag_if(fake, "classified_as_fake"),
                   flag_if(mismatch, "document_type_mismatch"))


def stage_timings(timings: DataFrame) -> DataFrame:
    """Per-document totals per stage; OCR time is spent once for the document.

    timings: document_id, stage, elapsed_ms."""
    exact = F.col("elapsed_ms").cast("decimal(20,3)")
    return timings.groupBy("document_id").pivot("stage", ["ocr", "classification", "detection", "signature", "stamp", "tamper"]).agg(
        F.sum(exact).cast("double"))


def page_timings(pages: DataFrame) -> DataFrame:
    """Per-page totals with the document's OCR time split evenly over its pages.

    pages: document_id, page_index, other_ms, and ocr_ms of the whole document."""
    counted = pages.groupBy("document_id").agg(F.count("*").alias("_pages"))
    share = round_to(F.col("ocr_ms") / F.col("_pages"), 3)
    return pages.join(counted, "document_id").select(
        "document_id", "page_index", share.alias("ocr_share_ms"), round_to(share + F.col("other_ms"), 3).alias("total_ms"))
