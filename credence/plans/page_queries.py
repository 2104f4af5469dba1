"""Registered queries: page stages rolled up to documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence import reference_values as V
from credence.functions.vectors import clip_box, valid_box
from credence.operators import result_columns as mapping
from credence.operators import rollup, stages
from credence.plans import domain as D
from credence.plans.domain_sql import with_views
from credence.plans.registry import query

PAGES = {"pages_": """
    SELECT l_orderkey AS document_id, l_linenumber * 1000000000000000000 + l_partkey * 1000000000 + l_suppkey AS page_index, l_partkey AS part, l_suppkey AS supp, qty, price, disc, tax, l_returnflag AS ret,
      CASE qty % 9 WHEN 0 THEN 'skipped' WHEN 1 THEN 'failed' ELSE 'completed' END AS class_status,
      CASE qty % 9 WHEN 0 THEN 'model_not_loaded' WHEN 1 THEN 'error' END AS class_reason,
      CASE WHEN disc = 10 THEN 'fake' ELSE ['bir_certificate', 'business_permit', 'dti_registration'][l_partkey % 3 + 1] END AS label,
      (50 + disc * 5) / 100.0::DOUBLE AS confidence,
      CASE WHEN disc = 10 THEN (price % 20) / 100.0::DOUBLE ELSE (80 + price % 20) / 100.0::DOUBLE END AS authenticity,
      CASE WHEN qty % 8 = 0 THEN 'skipped' ELSE 'completed' END AS detect_status,
      CASE WHEN l_returnflag = 'R' THEN 'skipped' WHEN qty % 5 = 0 THEN 'failed' ELSE 'completed' END AS sign_status,
      CASE WHEN l_returnflag <> 'R' AND qty % 5 <> 0 AND price % 4 <> 0 THEN (100 + qty) / 200.0::DOUBLE END AS similarity,
      CASE WHEN price % 6 = 0 THEN 'skipped' ELSE 'completed' END AS tamper_status,
      CASE WHEN price % 13 <> 0 THEN (price % 600) / 1000.0::DOUBLE END AS tamper_score,
      CASE WHEN price % 13 <> 0 THEN (1000 - price % 600) / 1000.0::DOUBLE END AS tamper_authenticity,
      (price % 90) / 100.0::DOUBLE AS tamper_confidence,
      CASE WHEN price % 7 <> 0 THEN price % 90 >= 80 END AS hard_flag, CASE WHEN price % 11 <> 0 THEN price % 600 < 500 END AS tamper_passed,
      list_filter([CASE WHEN price % 3 = 0 THEN 'ELA: region ' || (price % 5) END, CASE WHEN price % 5 = 0 THEN 'clone' END, CASE WHEN price % 2 = 0 THEN 'tamper_ela_unavailable' END], lambda x: x IS NOT NULL) AS tamper_flags
    FROM line_facts"""}


def pages(spark, folder, items=None):
    """One row per page: a line item is a page of its order's document."""
    items = D.table(spark, folder, "lineitem") if items is None else items
    qty, price, disc = D.whole("l_quantity"), D.whole("l_extendedprice"), D.hundredths("l_discount")
    part, ret = F.col("l_partkey"), F.col("l_returnflag")
    base = items.select(
        F.col("l_orderkey").alias("document_id"),
        (F.col("l_linenumber").cast("long") * 1000000000000000000 + part * 1000000000 + F.col("l_suppkey")).alias("page_index"),
        part.alias("part"), F.col("l_suppkey").alias("supp"), qty.alias("qty"), price.alias("price"), disc.alias("disc"), ret.alias("ret"))
    q, p, d = F.col("qty"), F.col("price"), F.col("disc")
    kinds = F.array(*[F.lit(x) for x in ("bir_certificate", "business_permit", "dti_registration")])
    keep = lambda *c: F.filter(F.array(*c), lambda x: x.isNotNull())
    return base.withColumns({
        "class_status": F.when(q % 9 == 0, "skipped").when(q % 9 == 1, "failed").otherwise("completed"),
        "class_reason": F.when(q % 9 == 0, "model_not_loaded").when(q % 9 == 1, "error"),
        "label": F.when(d == 10, "fake").otherwise(F.get(kinds, (F.col("part") % 3).cast("int"))),
        "confidence": (50 + d * 5) / 100.0,
        "authenticity": F.when(d == 10, (p % 20) / 100.0).otherwise((80 + p % 20) / 100.0),
        "detect_status": F.when(q % 8 == 0, "skipped").otherwise("completed"),
        "sign_status": F.when(F.col("ret") == "R", "skipped").when(q % 5 == 0, "failed").otherwise("completed"),
        "similarity": F.when((F.col("ret") != "R") & (q % 5 != 0) & (p % 4 != 0), (100 + q) / 200.0),
        "tamper_status": F.when(p % 6 == 0, "skipped").otherwise("completed"),
        "tamper_score": F.when(p % 13 != 0, (p % 600) / 1000.0),
        "tamper_authenticity": F.when(p % 13 != 0, (1000 - p % 600) / 1000.0),
        "tamper_confidence": (p % 90) / 100.0,
        "hard_flag": F.when(p % 7 != 0, p % 90 >= 80), "tamper_passed": F.when(p % 11 != 0, p % 600 < 500),
        "tamper_flags": keep(F.when(p % 3 == 0, F.concat(F.lit("ELA: region "), p % 5)), F.when(p % 5 == 0, "clone"),
                             F.when(p % 2 == 0, "tamper_ela_unavailable")),
    })


def sql(body: str, extra: dict[str, str] | None = None) -> str:
    return with_views(body, "line_facts", extra={**PAGES, **(extra or {})})


@query("classification_by_document", "E9", sql(
    """SELECT document_id, s.status, s.reason, s.label, s.confidence, s.authenticity, s.page_index FROM (SELECT document_id, coalesce(
         arg_min({'status': class_status, 'reason': class_reason, 'label': label, 'confidence': confidence, 'authenticity': authenticity, 'page_index': page_index},
                 (label <> 'fake', authenticity, page_index)) FILTER (class_status = 'completed'),
         arg_min({'status': class_status, 'reason': class_reason, 'label': label, 'confidence': confidence, 'authenticity': authenticity, 'page_index': page_index}, page_index)) AS s
       FROM pages_ GROUP BY 1)"""))
def classification_by_document(spark, folder):
    rows = pages(spark, folder).select("document_id", "page_index", F.col("class_status").alias("status"),
                                       F.col("class_reason").alias("reason"), "label", "confidence", "authenticity")
    return rollup.classification_rollup(rows)


@query("signature_by_document", "E11", sql(
    """SELECT document_id, s.status, s.similarity, s.page_index FROM (SELECT document_id, coalesce(
         arg_min({'status': sign_status, 'similarity': similarity, 'page_index': page_index}, (similarity, page_index)) FILTER (sign_status = 'completed' AND similarity IS NOT NULL),
         arg_min({'status': sign_status, 'similarity': similarity, 'page_index': page_index}, page_index) FILTER (sign_status = 'completed'),
         arg_min({'status': sign_status, 'similarity': similarity, 'page_index': page_index}, page_index)) AS s FROM pages_ GROUP BY 1)"""))
def signature_by_document(spark, folder):
    rows = pages(spark, folder).select("document_id", "page_index", F.col("sign_status").alias("status"), "similarity")
    return rollup.verification_rollup(rows, "similarity")


_TAMPER_FLAGS = """SELECT document_id, string_agg(flag, '; ' ORDER BY a, b) AS flags FROM (
    SELECT document_id, flag, min((page_index, pos))[1] AS a, min((page_index, pos))[2] AS b FROM (
      SELECT document_id, page_index, unnest(tamper_flags) AS flag, generate_subscripts(tamper_flags, 1) AS pos FROM pages_ WHERE tamper_status = 'completed') GROUP BY 1, 2) GROUP BY 1"""


@query("tamper_by_document", "E12 H13", sql(
    """SELECT document_id, detail, worst_page, tamper_score, tamper_authenticity, tamper_confidence, hard_flag, tamper_passed, page_count, coalesce(flags, '') AS flags FROM (
       SELECT document_id, arg_max('page ' || price, (coalesce(tamper_score, 0), -page_index)) FILTER (tamper_status = 'completed') AS detail,
         arg_max(page_index, (coalesce(tamper_score, 0), -page_index)) FILTER (tamper_status = 'completed') AS worst_page,
         max(coalesce(tamper_score, 0)) FILTER (tamper_status = 'completed') AS tamper_score,
         min(coalesce(tamper_authenticity, 1)) FILTER (tamper_status = 'completed') AS tamper_authenticity,
         max(tamper_confidence) FILTER (tamper_status = 'completed') AS tamper_confidence,
         bool_or(coalesce(hard_flag, FALSE)) FILTER (tamper_status = 'completed') AS hard_flag,
         bool_and(coalesce(tamper_passed, FALSE)) FILTER (tamper_status = 'completed') AS tamper_passed,
         count(*) FILTER (tamper_status = 'completed') AS page_count FROM pages_ GROUP BY 1) LEFT JOIN tflags USING (document_id)""", {"tflags": _TAMPER_FLAGS}))
def tamper_by_document(spark, folder):
    rows = pages(spark, folder).select(
        "document_id", "page_index", F.col("tamper_status").alias("status"), "tamper_score", "tamper_authenticity", "tamper_confidence",
        "hard_flag", "tamper_passed", F.col("tamper_flags").alias("flags"), F.concat(F.lit("page "), "price").alias("detail"))
    return rollup.tamper_rollup(rows).withColumn("flags", F.array_join("flags", "; "))


_BOXES = """SELECT document_id, page_index, pos, CASE label WHEN 'stamp_seal' THEN 'stamp' ELSE label END AS label, confidence, x1, y1 FROM (
    SELECT document_id, page_index, unnest([{'pos': 0, 'label': ['signature', 'stamp_seal', 'logo'][part % 3 + 1], 'confidence': (50 + disc * 5) / 100.0::DOUBLE, 'x1': supp % 50, 'y1': qty},
      {'pos': 1, 'label': ['stamp_seal', 'logo', 'signature'][supp % 3 + 1], 'confidence': (40 + qty) / 100.0::DOUBLE, 'x1': part % 50, 'y1': qty}], recursive := true)
    FROM pages_ WHERE detect_status = 'completed')"""


def _detections(spark, folder):
    names = lambda *x: F.array(*[F.lit(v) for v in x])
    def box(x, y):
        return F.array(x.cast("double"), y.cast("double"), (x + 80).cast("double"), (y + 40).cast("double"))
    one = F.struct(F.get(names("signature", "stamp_seal", "logo"), (F.col("part") % 3).cast("int")).alias("label"),
                   ((50 + F.col("disc") * 5) / 100.0).alias("confidence"), box(F.col("supp") % 50, F.col("qty")).alias("box"))
    two = F.struct(F.get(names("stamp_seal", "logo", "signature"), (F.col("supp") % 3).cast("int")).alias("label"),
                   ((40 + F.col("qty")) / 100.0).alias("confidence"), box(F.col("part") % 50, F.col("qty")).alias("box"))
    none = F.slice(F.array(one, two), 1, 0)
    done = F.col("detect_status") == "completed"
    rows = pages(spark, folder).select("document_id", "page_index", F.col("detect_status").alias("status"),
                                       F.when(done, F.array(one, two)).otherwise(none).alias("detections"))
    return rows


@query("detections_by_document", "B21 E10", sql(
    "SELECT document_id, page_index, CAST(pos AS INTEGER) AS pos, label, confidence, TRUE AS usable FROM boxes", {"boxes": _BOXES}))
def detections_by_document(spark, folder):

    rows = rollup.detection_rows(_detections(spark, folder))
    return rows.select("document_id", "page_index", "pos", "label", "confidence", valid_box(F.col("box")).alias("usable"))


@query("missing_detections", "D14 E10 H12", sql(
    """SELECT document_id, string_agg(flag, '; ' ORDER BY a, b) AS flags FROM (
       SELECT document_id, flag, min((page_index, pos))[1] AS a, min((page_index, pos))[2] AS b FROM (
         SELECT document_id, page_index, unnest(flags) AS flag, generate_subscripts(flags, 1) AS pos FROM (
           SELECT document_id, page_index, list_filter([CASE WHEN NOT list_contains(found, 'signature') THEN 'no_signature_detected' END,
             CASE WHEN NOT list_contains(found, 'stamp') THEN 'no_stamp_detected' END, CASE WHEN NOT list_contains(found, 'logo') THEN 'no_logo_detected' END], lambda x: x IS NOT NULL) AS flags
           FROM (SELECT document_id, page_index, list(label) AS found FROM boxes GROUP BY 1, 2))) GROUP BY 1, 2) GROUP BY 1""", {"boxes": _BOXES}))
def missing_detections(spark, folder):
    alias = lambda x: F.when(x["label"] == "stamp_seal", "stamp").otherwise(x["label"])
    rows = _detections(spark, folder).where(F.col("status") == "completed").select(
        "document_id", "page_index", rollup.missing_labels(F.transform("detections", alias)).alias("flags"))
    return rollup.detection_flags(rows).withColumn("flags", F.array_join("flags", "; "))


@query("best_stamp_box", "E16 B22", sql(
    """SELECT document_id, b.label, b.confidence, b.page_index, b.x1 + 80 AS right_edge FROM (
       SELECT document_id, arg_max({'label': label, 'confidence': confidence, 'page_index': page_index, 'x1': x1}, (confidence, -page_index, -pos)) AS b
       FROM boxes WHERE label IN ('stamp', 'logo') GROUP BY 1)""", {"boxes": _BOXES}))
def best_stamp_box(spark, folder):

    best = rollup.best_boxes(rollup.detection_rows(_detections(spark, folder)), ["document_id"], ("stamp", "logo"))
    clipped = clip_box(F.col("box"), F.lit(2000), F.lit(2000))
    return best.select("document_id", "label", "confidence", "page_index", F.get(clipped, 2).cast("long").alias("right_edge"))


_FIELDS = """SELECT document_id, page_index, class_status AS status, ord, field_key, CASE WHEN (price + ord) % 6 <> 0 THEN CASE WHEN (price + ord) % 8 = 0 THEN '' ELSE 'v' || ((part + ord) % 2) || CASE WHEN price % 2 = 0 THEN ' ' ELSE '' END END END AS value,
    (price + ord) % 6 <> 0 AS matched, ord < 2 AS required, CASE WHEN (price + ord) % 7 <> 0 THEN (price % 1000) / 10.0::DOUBLE END AS confidence
    FROM (SELECT *, unnest([{'ord': 0, 'field_key': 'tin'}, {'ord': 1, 'field_key': 'trade_name'}, {'ord': 2, 'field_key': 'rdo_code'}], recursive := true) FROM pages_)"""
_READ = """SELECT * FROM fields WHERE status = 'completed' AND matched AND value IS NOT NULL AND value <> ''"""
_MERGED = """SELECT document_id, field_key, arg_max({'value': value, 'confidence': confidence, 'required': required, 'page_index': page_index}, (coalesce(confidence, 101.0::DOUBLE), -page_index)) AS f,
    count(DISTINCT trim(value)) > 1 AS conflict, min((page_index, ord)) AS first_seen FROM read_fields GROUP BY 1, 2"""
_FIELD_VIEWS = {"fields": _FIELDS, "read_fields": _READ, "merged": _MERGED}


def _fields(spark, folder):
    p, o = F.col("price"), F.col("ord")
    spec = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("field_key")) for i, k in enumerate(("tin", "trade_name", "rdo_code"))])
    rows = pages(spark, folder).select("document_id", "page_index", F.col("class_status").alias("status"), "price", "part", F.inline(spec))
    value = F.concat(F.lit("v"), (F.col("part") + o) % 2, F.when(p % 2 == 0, " ").otherwise(""))
    return rows.select(
        "document_id", "page_index", "status", "ord", "field_key",
        F.when((p + o) % 6 != 0, F.when((p + o) % 8 == 0, "").otherwise(value)).alias("value"),
        ((p + o) % 6 != 0).alias("matched"), (o < 2).alias("required"),
        F.when((p + o) % 7 != 0, (p % 1000) / 10.0).alias("confidence"))


@query("merged_fields", "E13 E14", sql(
    "SELECT document_id, field_key, f.value AS value, f.confidence AS confidence, f.required AS required, f.page_index AS page_index, conflict FROM merged", _FIELD_VIEWS))
def merged_fields(spark, folder):
    return rollup.merged_fields(_fields(spark, folder).where(F.col("status") == "completed")).drop("first_seen")


_QUALITY = """SELECT *, (price % 1000) / 10.0::DOUBLE AS mean_confidence, 2 + price % 2 AS required_total, (price % 100) / 100.0::DOUBLE AS tv, price % 100 >= 70 AS passes,
    list_filter([CASE WHEN price % 10 = 0 THEN 'insufficient_text' END, CASE WHEN (price % 1000) < 600 THEN 'low_ocr_confidence' END], lambda x: x IS NOT NULL) AS qflags FROM pages_ WHERE class_status = 'completed'"""


@query("ocr_by_document", "E14 E15 E23", sql(
    """SELECT q.document_id, page_count, CAST(round(CAST(mean_confidence AS DECIMAL(20,9)), 1) AS DOUBLE) AS mean_confidence, required_total, coalesce(required_matched, 0) AS required_matched,
       text_validation_score, passes_text_validation, concat_ws('; ', nullif(qf.flags, ''), CASE WHEN coalesce(conflicting, '') <> '' THEN 'ocr_field_conflict' END) AS flags, coalesce(conflicting, '') AS conflicting_fields
       FROM (SELECT document_id, count(*) AS page_count, max(mean_confidence) AS mean_confidence, max(required_total) AS required_total, max(tv) AS text_validation_score, bool_or(passes) AS passes_text_validation FROM quality GROUP BY 1) q
       LEFT JOIN (SELECT document_id, count(*) FILTER (f.required) AS required_matched, string_agg(field_key, '; ' ORDER BY first_seen) FILTER (conflict) AS conflicting FROM merged GROUP BY 1) m USING (document_id)
       LEFT JOIN (SELECT document_id, string_agg(flag, '; ' ORDER BY s) AS flags FROM (SELECT document_id, flag, min((page_index, pos)) AS s FROM (
         SELECT document_id, page_index, unnest(qflags) AS flag, generate_subscripts(qflags, 1) AS pos FROM quality) GROUP BY 1, 2) GROUP BY 1) qf USING (document_id)""",
    {**_FIELD_VIEWS, "quality": _QUALITY}))
def ocr_by_document(spark, folder):
    p = F.col("price")
    keep = F.filter(F.array(F.when(p % 10 == 0, "insufficient_text"), F.when(p % 1000 < 600, "low_ocr_confidence")), lambda x: x.isNotNull())
    quality = pages(spark, folder).select(
        "document_id", "page_index", F.col("class_status").alias("status"), ((p % 1000) / 10.0).alias("mean_confidence"),
        (2 + p % 2).alias("required_total"), ((p % 100) / 100.0).alias("text_validation_score"), (p % 100 >= 70).alias("passes"), keep.alias("flags"))
    read = _fields(spark, folder).where(F.col("status") == "completed").drop("status")
    rows = rollup.ocr_rollup(read, quality)
    return rows.withColumn("flags", F.array_join("flags", "; ")).withColumn("conflicting_fields", F.array_join("conflicting_fields", "; "))


@query("page_class_flags", "E37 H11", sql(
    """SELECT document_id, page_index, array_to_string(list_filter([CASE WHEN confidence < 0.70::DOUBLE THEN 'low_classification_confidence' END, CASE WHEN label = 'fake' THEN 'classified_as_fake' END,
       CASE WHEN label <> 'fake' AND confidence >= 0.70::DOUBLE AND declared IN ('bir_certificate', 'business_permit', 'dti_registration') AND label <> declared THEN 'document_type_mismatch' END], lambda x: x IS NOT NULL), '; ') AS flags
       FROM (SELECT *, ['bir_certificate', 'business_permit', 'passport', NULL][supp % 4 + 1] AS declared FROM pages_)"""))
def page_class_flags(spark, folder):
    declared = F.get(F.array(F.lit("bir_certificate"), F.lit("business_permit"), F.lit("passport"), F.lit(None)), (F.col("supp") % 4).cast("int"))
    known = ["bir_certificate", "business_permit", "dti_registration"]
    flags = rollup.classification_flags(F.col("label"), F.col("confidence") >= 0.70, declared, known)
    return pages(spark, folder).select("document_id", "page_index", F.array_join(flags, "; ").alias("flags"))


@query("page_stage_plan", "B26 I17 I16", sql(
    """SELECT document_id, page_index, CASE WHEN supp % 5 = 0 THEN 'skipped:unsupported_document_type' WHEN part % 7 = 0 THEN 'skipped:model_not_loaded' WHEN qty % 11 = 0 THEN 'failed:error' ELSE 'completed:' END AS classification,
       CASE WHEN part % 9 = 0 THEN 'skipped:model_not_loaded' WHEN qty % 13 = 0 THEN 'failed:error' ELSE 'completed:' END AS detection,
       CASE WHEN part % 8 = 0 THEN 'skipped:model_not_loaded' WHEN price % 3 = 0 THEN 'skipped:no_reference_embedding' WHEN part % 9 = 0 OR qty % 13 = 0 THEN 'skipped:detection_unavailable'
            WHEN price % 4 = 0 THEN 'skipped:no_signature_detected' WHEN qty % 17 = 0 THEN 'failed:error' ELSE 'completed:' END AS signature,
       CASE WHEN scope IS NULL OR scope = 'none' THEN 'skipped:no_issuer_logo' WHEN part % 10 = 0 THEN 'skipped:model_not_loaded' WHEN part % 9 = 0 OR qty % 13 = 0 THEN 'skipped:detection_unavailable'
            WHEN price % 5 = 0 THEN 'skipped:no_stamp_detected' WHEN qty % 19 = 0 THEN 'failed:error' ELSE 'completed:' END AS stamp,
       CASE WHEN qty % 23 = 0 THEN 'failed:error' ELSE 'completed:' END AS tamper,
       CASE label WHEN 'bir_certificate' THEN 'bir' WHEN 'business_permit' THEN 'business_permit' WHEN 'dti_registration' THEN 'dti' ELSE 'none' END AS template,
       CASE WHEN label = 'bir_certificate' THEN CASE WHEN part % 6 <> 0 THEN 'accurate' WHEN part % 4 <> 0 THEN 'fast' END ELSE CASE WHEN part % 4 <> 0 THEN 'fast' WHEN part % 6 <> 0 THEN 'accurate' END END AS recogniser
       FROM (SELECT *, ['national', 'lgu', NULL, 'none'][supp % 4 + 1] AS scope FROM pages_)"""))
def page_stage_plan(spark, folder):
    part, qty, price = F.col("part"), F.col("qty"), F.col("price")
    scope = F.get(F.array(F.lit("national"), F.lit("lgu"), F.lit(None), F.lit("none")), (F.col("supp") % 4).cast("int"))
    plan = stages.stage_plan(
        F.col("supp") % 5 == 0,
        {"classifier": part % 7 != 0, "detector": part % 9 != 0, "siamese": part % 8 != 0, "stamp": part % 10 != 0},
        price % 3 != 0, price % 4 != 0, price % 5 != 0, scope,
        {"classification": qty % 11 == 0, "detection": qty % 13 == 0, "signature": qty % 17 == 0, "stamp": qty % 19 == 0, "tamper": qty % 23 == 0})
    template = stages.template_for(F.col("label"))
    shown = {k: F.concat(v["status"], F.lit(":"), F.coalesce(v["reason"], F.lit(""))) for k, v in plan.items()}
    return pages(spark, folder).select("document_id", "page_index", *[v.alias(k) for k, v in shown.items()], template.alias("template"),
                                       stages.recogniser_for(template, ("bir",), part % 4 != 0, part % 6 != 0).alias("recogniser"))


@query("class_from_probabilities", "B25", sql(
    """SELECT document_id, page_index, names[list_position(ps, list_max(ps))] AS label, list_max(ps) AS confidence, CAST(round(CAST(1.0::DOUBLE - ps[3] AS DECIMAL(20,9)), 6) AS DOUBLE) AS authenticity, list_max(ps) >= 0.70::DOUBLE AS passed
       FROM (SELECT *, ['bir_certificate', 'business_permit', 'fake'] AS names, [(price % 100) / 100.0::DOUBLE, (part % 100) / 100.0::DOUBLE, (qty * 2) / 100.0::DOUBLE] AS ps FROM pages_)"""))
def class_from_probabilities(spark, folder):
    scores = {"bir_certificate": (F.col("price") % 100) / 100.0, "business_permit": (F.col("part") % 100) / 100.0, "fake": (F.col("qty") * 2) / 100.0}
    array = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("p")) for n, v in scores.items()])
    return pages(spark, folder).select("document_id", "page_index", stages.class_from_probabilities(array).alias("c")).select("document_id", "page_index", "c.*")


@query("stage_timings", "E38", sql(
    """SELECT document_id, CAST(sum(CAST(qty * 3 AS DECIMAL(20,3))) AS DOUBLE) AS ocr, CAST(sum(CAST(price % 97 / 8.0 AS DECIMAL(20,3))) AS DOUBLE) AS classification,
       CAST(sum(CAST(part % 89 / 8.0 AS DECIMAL(20,3))) AS DOUBLE) AS detection, CAST(sum(CAST(supp % 83 / 8.0 AS DECIMAL(20,3))) AS DOUBLE) AS signature,
       CAST(sum(CAST(disc / 8.0 AS DECIMAL(20,3))) AS DOUBLE) AS stamp, CAST(sum(CAST(price % 71 / 8.0 AS DECIMAL(20,3))) AS DOUBLE) AS tamper FROM pages_ GROUP BY 1"""))
def stage_timings(spark, folder):
    parts = {"ocr": F.col("qty") * 3.0, "classification": F.col("price") % 97 / 8.0, "detection": F.col("part") % 89 / 8.0,
             "signature": F.col("supp") % 83 / 8.0, "stamp": F.col("disc") / 8.0, "tamper": F.col("price") % 71 / 8.0}
    rows = F.array(*[F.struct(F.lit(k).alias("stage"), v.alias("elapsed_ms")) for k, v in parts.items()])
    return rollup.stage_timings(pages(spark, folder).select("document_id", F.inline(rows)))


@query("page_timings", "E38", sql(
    """SELECT document_id, page_index, CAST(round(CAST(w / n AS DECIMAL(20,9)), 3) AS DOUBLE) AS ocr_share_ms,
       CAST(round(CAST(CAST(round(CAST(w / n AS DECIMAL(20,9)), 3) AS DOUBLE) + price % 97 / 8.0::DOUBLE AS DECIMAL(20,9)), 3) AS DOUBLE) AS total_ms FROM pages_ JOIN (SELECT document_id, count(*) AS n, CAST(sum(qty * 3) AS DOUBLE) AS w FROM pages_ GROUP BY 1) USING (document_id)"""))
def page_timings(spark, folder):
    rows = pages(spark, folder).select("document_id", "page_index", "qty", (F.col("price") % 97 / 8.0).alias("other_ms"))
    totals = rows.groupBy("document_id").agg(F.sum(F.col("qty") * 3).cast("double").alias("ocr_ms"))
    return rollup.page_timings(rows.drop("qty").join(totals, "document_id"))


_RUN_SQL = {"runs_": """SELECT document_id, supp, {'p': page_index, 'a': price, 'q': qty, 'd': disc} AS version, CASE WHEN part % 7 <> 0 THEN [part % 900, price % 700, 10 + supp % 80, qty] END AS signature_bbox, CASE WHEN supp % 5 <> 0 THEN [part % 640, price % 480, 40, 40] END AS stamp_bbox,
      class_status = 'completed' AS c_ran, label, confidence, authenticity, qty % 4 <> 0 AS o_ran, 'page ' || part AS text, disc * 10.0::DOUBLE AS ocr_confidence, (100 - price % 50) / 100.0::DOUBLE AS text_score, qty % 6 AS matched,
      CASE WHEN part % 3 = 0 THEN 'City ' || (supp % 20) END AS city, price % 5 <> 0 AS s_there, price % 5 > 2 AS s_ran, price % 5 = 1 AS s_unknown, qty / 20.0::DOUBLE AS distance,
      supp % 4 <> 0 AS t_there, supp % 4 > 1 AS t_ran, CASE supp % 4 WHEN 1 THEN 'no_stamp_detected' WHEN 2 THEN 'unreferenced_logo' END AS t_reason, (700 + part % 300) / 1000.0::DOUBLE AS stamp_similarity,
      CASE WHEN part % 2 = 0 THEN disc % 2 = 0 END AS tampered, CASE WHEN price % 3 <> 0 THEN 'lgu' END AS scope FROM pages_"""}


def _latest(value: str, when: str) -> str:
    return f"arg_max({{'v': {value}}}, version) FILTER ({when}).v"


@query("result_columns", "E22 H1", sql(
    f"""SELECT document_id, {', '.join(f"{_latest(v, w)} AS {n}" for n, v, w in (
        ("signature_bbox", "array_to_string(signature_bbox, ',')", "TRUE"), ("stamp_bbox", "array_to_string(stamp_bbox, ',')", "TRUE"),
        ("classification_label", "label", "c_ran"), ("classification_confidence", "confidence", "c_ran"), ("classification_authenticity", "authenticity", "c_ran"),
        ("ocr_extracted_text", "text", "o_ran"), ("ocr_confidence", "ocr_confidence", "o_ran"), ("text_validation_score", "text_score", "o_ran"),
        ("text_fields_matched", "matched", "o_ran"), ("text_fields_expected", "CAST(6 AS BIGINT)", "o_ran"), ("detected_city", "city", "o_ran AND city IS NOT NULL"),
        ("signature_distance", "distance", "s_ran"), ("signature_passed", "distance <= 1.243976::DOUBLE", "s_ran"),
        ("signature_score", "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - distance / (2.0::DOUBLE * 1.243976::DOUBLE))), 4)", "s_ran"),
        ("signature_detected", "s_ran", "s_there"), ("stamp_tampered", "tampered", "t_ran AND tampered IS NOT NULL"),
        ("stamp_similarity", "stamp_similarity", "t_ran AND t_reason IS NULL"), ("stamp_score", "stamp_similarity", "t_ran AND t_reason IS NULL"),
        ("stamp_passed", "stamp_similarity >= 0.85::DOUBLE", "t_ran AND t_reason IS NULL"), ("logo_reference_id", "supp", "t_ran AND t_reason IS NULL"),
        ("stamp_detected", "t_ran AND t_reason IS NULL", "t_there"),
        ("flags", "concat_ws('; ', CASE WHEN s_ran AND distance > 1.243976::DOUBLE THEN 'signature_mismatch' END, CASE WHEN s_unknown THEN 'no_signature_reference' END, "
                  "CASE WHEN t_ran AND t_reason IS NULL AND stamp_similarity < 0.85::DOUBLE THEN 'stamp_mismatch' END, CASE WHEN t_there AND NOT (t_ran AND t_reason IS NULL) THEN CASE WHEN scope IS NULL THEN 'no_issuer_logo' ELSE t_reason END END)", "TRUE")))}
       FROM runs_ GROUP BY document_id""", _RUN_SQL))
def result_columns(spark, folder):
    """The result row of every document after all its runs: a page is a run, and
    stages are absent, skipped or completed on it. A group of columns keeps what the
    last run left that filled it.

    Line items are shuffled and put in order by document before stages are spelled out,
    so that neither a shuffle nor a sort holds the wide rows."""
    items = D.table(spark, folder, "lineitem").repartition("l_orderkey").sortWithinPartitions("l_orderkey")
    c, lit = F.col, lambda v: F.lit(v)
    state = lambda done, reason=None: (F.when(done, "completed").otherwise("skipped").alias("status"), *([] if reason is None else [reason.alias("reason")]))
    distance, similarity = c("qty") / 20.0, (700 + c("part") % 300) / 1000.0
    stamp_reason = F.when(c("supp") % 4 == 1, "no_stamp_detected").when(c("supp") % 4 == 2, "unreferenced_logo")
    runs = pages(spark, folder, items).select(
        "document_id", F.struct("page_index", "price", "qty", "disc").alias("version"),
        F.when(c("part") % 7 != 0, F.array(c("part") % 900, c("price") % 700, 10 + c("supp") % 80, c("qty"))).alias("signature_bbox"),
        F.when(c("supp") % 5 != 0, F.array(c("part") % 640, c("price") % 480, lit(40), lit(40))).alias("stamp_bbox"),
        F.struct(c("class_status").alias("status"), "label", "confidence", "authenticity").alias("classification"),
        F.struct(*state(c("qty") % 4 != 0), F.concat(lit("page "), "part").alias("text"), (c("disc") * 10.0).alias("confidence"), ((100 - c("price") % 50) / 100.0).alias("score"),
                 (c("qty") % 6).alias("matched"), lit(6).cast("long").alias("expected"), F.when(c("part") % 3 == 0, F.concat(lit("City "), c("supp") % 20)).alias("city"), lit(1).alias("pages")).alias("ocr"),
        F.when(c("price") % 5 != 0, F.struct(*state(c("price") % 5 > 2, F.when(c("price") % 5 == 1, "no_reference_embedding").when(c("price") % 5 == 2, "no_signature_detected")),
                                             distance.alias("distance"), lit(V.SIGNATURE_DISTANCE).alias("threshold"), (distance <= V.SIGNATURE_DISTANCE).alias("match"))).alias("signature"),
        F.when(c("supp") % 4 != 0, F.struct(*state(c("supp") % 4 > 1, stamp_reason), similarity.alias("similarity"), (similarity >= 0.85).alias("match"),
                                            F.when(c("part") % 2 == 0, c("disc") % 2 == 0).alias("tampered"), c("supp").alias("reference_id"))).alias("stamp"),
        F.when(c("price") % 3 != 0, "lgu").alias("issuer_scope"))
    rows = mapping.merge_runs(mapping.map_stages(runs, ["document_id", "version"]), ["document_id"], "version").drop("filled")
    return rows.withColumns({n: F.array_join(n, ",") for n in ("signature_bbox", "stamp_bbox")} | {"flags": F.array_join("flags", "; ")})
