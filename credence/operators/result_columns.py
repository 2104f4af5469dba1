"""Stage outputs of a run as flat result columns, and their merge over runs.

Columns come in groups. A run fills the groups of the stages that ran; the others keep
what an earlier run left there, also where that run filled them with NULL. Which
groups a run fills is part of its row (``filled``), so runs can be merged one by one,
a batch at a time, or all at once, with the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.arrays import compact, flag_if
from credence.functions.vectors import calibrated_score

#: Group -> its columns.
GROUPS: dict[str, tuple[str, ...]] = {
    "boxes": ("signature_bbox", "stamp_bbox"),
    "classification": ("classification_label", "classification_confidence", "classification_authenticity"),
    "text": ("ocr_extracted_text", "ocr_confidence", "text_validation_score", "text_fields_matched", "text_fields_expected"),
    "city": ("detected_city",),
    "signature": ("signature_distance", "signature_passed", "signature_score"),
    "signature_seen": ("signature_detected",),
    "texture": ("stamp_tampered",),
    "stamp": ("stamp_similarity", "stamp_score", "stamp_passed", "logo_reference_id"),
    "stamp_seen": ("stamp_detected",),
    "flags": ("flags",),
}


def map_stages(runs: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, the result columns and ``filled`` of every run.

    runs: signature_bbox and stamp_bbox (best boxes of the detection) and one struct
    per stage, NULL where the stage is absent: classification (status, label,
    confidence, authenticity), ocr (status, text, confidence, score, matched, expected,
    city; pages, how many were read), signature (status, reason, distance, threshold,
    match), stamp (status, reason, similarity, match, tampered, reference_id), and
    issuer_scope. A stage ran if its status is ``completed``."""
    ran = lambda stage: F.coalesce(F.col(f"{stage}.status") == "completed", F.lit(False))
    there = lambda stage: F.col(stage).isNotNull()
    marked = runs.withColumns({f"_{s}": ran(s) for s in ("classification", "ocr", "signature", "stamp")})
    read = F.col("_ocr") & (F.coalesce("ocr.pages", F.lit(0)) > 0)
    compared = F.col("_stamp") & F.col("stamp.reason").isNull()
    missed = there("stamp") & ~compared
    when = {
        "boxes": F.lit(True), "classification": F.col("_classification"), "text": read, "city": read & F.col("ocr.city").isNotNull(),
        "signature": F.col("_signature"), "signature_seen": there("signature"), "texture": F.col("_stamp") & F.col("stamp.tampered").isNotNull(),
        "stamp": compared, "stamp_seen": there("stamp"), "flags": F.lit(True)}
    flags = compact(
        flag_if(F.col("_signature") & ~F.col("signature.match"), "signature_mismatch"),
        flag_if(there("signature") & ~F.col("_signature") & (F.col("signature.reason") == "no_reference_embedding"), "no_signature_reference"),
        flag_if(compared & ~F.col("stamp.match"), "stamp_mismatch"),
        flag_if(missed & F.col("issuer_scope").isNull(), "no_issuer_logo"),
        F.when(missed & F.col("issuer_scope").isNotNull(), F.col("stamp.reason")))
    value = {
        "signature_bbox": F.col("signature_bbox"), "stamp_bbox": F.col("stamp_bbox"),
        "classification_label": F.col("classification.label"), "classification_confidence": F.col("classification.confidence"),
        "classification_authenticity": F.col("classification.authenticity"),
        "ocr_extracted_text": F.col("ocr.text"), "ocr_confidence": F.col("ocr.confidence"), "text_validation_score": F.col("ocr.score"),
        "text_fields_matched": F.col("ocr.matched"), "text_fields_expected": F.col("ocr.expected"), "detected_city": F.col("ocr.city"),
        "signature_distance": F.col("signature.distance"), "signature_passed": F.col("signature.match"),
        "signature_score": calibrated_score(F.col("signature.distance"), F.col("signature.threshold")), "signature_detected": F.col("_signature"),
        "stamp_tampered": F.col("stamp.tampered"), "stamp_similarity": F.col("stamp.similarity"), "stamp_score": F.col("stamp.similarity"),
        "stamp_passed": F.col("stamp.match"), "logo_reference_id": F.col("stamp.reference_id"), "stamp_detected": compared, "flags": F.array_distinct(flags)}
    columns = [F.when(when[g], value[c]).alias(c) for g, names in GROUPS.items() for c in names]
    return marked.select(*keys, *columns, compact(*[flag_if(condition, g) for g, condition in when.items()]).alias("filled"))


def merge_runs(runs: DataFrame, keys: list[str], version: str) -> DataFrame:
    """All runs of a key as one row: of each group what the latest run left that filled
    it. ``runs`` as from ``map_stages``, with ``version`` to order them."""
    groups = {g: F.struct(*names) for g, names in GROUPS.items()}
    has = lambda g: F.array_contains("filled", g)
    picked = [F.max_by(s, F.when(has(g), F.col(version))).alias(f"_{g}") for g, s in groups.items()]
    ever = compact(*[flag_if(F.max(has(g)), g) for g in groups]).alias("filled")
    rows = runs.groupBy(*keys).agg(*picked, ever)
    return rows.select(*keys, *[F.col(f"_{g}.{c}").alias(c) for g, names in GROUPS.items() for c in names], "filled")


def merge_later(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows brought up to date by later ones, one per key on either side."""
    old = stored.select(*keys, *[F.col(c).alias(f"_{c}") for c in stored.columns if c not in keys], F.lit(True).alias("_old"))
    new = fresh.select(*fresh.columns, F.lit(True).alias("_new"))
    both = new.join(old, keys, "full_outer")
    columns = [F.when(F.coalesce(F.array_contains("filled", g), F.lit(False)), F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for g, names in GROUPS.items() for c in names]
    none = F.array().cast("array<string>")
    either = F.array_union(F.coalesce("_filled", none), F.coalesce("filled", none))
    return both.select(*keys, *columns, F.filter(F.array(*[F.lit(g) for g in GROUPS]), lambda g: F.array_contains(either, g)).alias("filled"))
