"""Which stage runs, is skipped or fails on a page, and routing plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.arrays import one_of


def template_for(type_code: Column) -> Column:
    """Field template of a document type; 'none' where there is none."""
    return one_of(F.lower(F.trim(type_code)), V.TYPE_TEMPLATES, F.lit("none"))


def recogniser_for(template: Column, accurate: tuple[str, ...], has_fast: Column, has_accurate: Column) -> Column:
    """Preferred recogniser by template, the other one when it is not loaded."""
    preferred = template.isin(*accurate)
    return (F.when(preferred & has_accurate, "accurate").when(preferred & has_fast, "fast")
            .when(has_fast, "fast").when(has_accurate, "accurate"))


def _outcome(status: str, reason: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))


def _ladder(*steps: tuple[Column, Column], otherwise: Column) -> Column:
    chain = None
    for condition, outcome in steps:
        chain = F.when(condition, outcome) if chain is None else chain.when(condition, outcome)
    return chain.otherwise(otherwise)


def stage_plan(unsupported: Column, models: dict[str, Column], has_signature_reference: Column,
               has_signature_box: Column, has_stamp_box: Column, issuer_scope: Column,
               broken: dict[str, Column]) -> dict[str, Column]:
    """Outcome STRUCT(status, reason) per stage with the fixed precedence of the
    checks. ``models``: loaded flags for classifier, detector, siamese, stamp;
    ``broken``: whether the stage raised an error on this page."""
    not_loaded, failed, done = _outcome("skipped", "model_not_loaded"), _outcome("failed", "error"), _outcome("completed")
    detected = models["detector"] & ~broken["detection"]
    no_scope = issuer_scope.isNull() | F.lower(issuer_scope).isin("none", "null")
    return {
        "classification": _ladder(
            (unsupported, _outcome("skipped", "unsupported_document_type")), (~models["classifier"], not_loaded),
            (broken["classification"], failed), otherwise=done),
        "detection": _ladder((~models["detector"], not_loaded), (broken["detection"], failed), otherwise=done),
        "signature": _ladder(
            (~models["siamese"], not_loaded), (~has_signature_reference, _outcome("skipped", "no_reference_embedding")),
            (~detected, _outcome("skipped", "detection_unavailable")),
            (~has_signature_box, _outcome("skipped", "no_signature_detected")), (broken["signature"], failed), otherwise=done),
        "stamp": _ladder(
            (no_scope, _outcome("skipped", "no_issuer_logo")), (~models["stamp"], not_loaded),
            (~detected, _outcome("skipped", "detection_unavailable")),
            (~has_stamp_box, _outcome("skipped", "no_stamp_detected")), (broken["stamp"], failed), otherwise=done),
        "tamper": _ladder((broken["tamper"], failed), otherwise=done),
    }


def class_from_probabilities(probabilities: Column, threshold: float = 0.70) -> Column:
    """STRUCT(label, confidence, authenticity, passed) of a class->probability
    array of STRUCT(name, p); the first of equal probabilities wins."""
    values = F.transform(probabilities, lambda x: x["p"])
    best = F.array_max(values)
    at = F.array_position(values, best).cast("int")
    fake = F.coalesce(F.get(F.transform(F.filter(probabilities, lambda x: x["name"] == "fake"), lambda x: x["p"]), 0), F.lit(0.0))
    return F.struct(F.try_element_at(probabilities, at)["name"].alias("label"), best.alias("confidence"),
                    F.round((F.lit(1.0) - fake).cast("decimal(20,9)"), 6).cast("double").alias("authenticity"),
                    (best >= threshold).alias("passed"))
