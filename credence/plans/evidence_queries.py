"""Registered queries: vectors, calibration and forensic evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions.hashing import hash32
from credence.functions.vectors import as_doubles, cosine, euclidean, vector_fault
from credence.operators import datasets, forensics, verify
from credence.plans import domain as D
from credence.plans.domain_sql import with_views
from credence.plans.page_queries import pages, sql as page_sql
from credence.plans import text_queries  # noqa: F401 - the identifier checks
from credence.plans.registry import QUERIES, STATEMENTS, query


def vectors(spark, folder):
    return D.table(spark, folder, "embeddings").select("vec_id", "label", as_doubles(F.col("embedding")).alias("vector"))


_CENTROIDS = """SELECT label, list_transform(m, lambda x: x / sqrt(list_reduce(list_transform(m, lambda y: y * y), lambda p, q: p + q))) AS reference FROM (
    SELECT label, list(v ORDER BY i) AS m FROM (SELECT label, i, avg(e) AS v FROM (
      SELECT label, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"""
_D = "CAST(embedding AS DOUBLE[])"


@query("signature_verification", "B24 F1 F3 F6", with_views(
    f"""SELECT vec_id, round(d, 6) AS distance, round(1.0 / (1.0 + d), 6) AS similarity, d <= 1.243976 AS match, round(greatest(0, least(1, 1 - d / (2 * 1.243976))), 4) AS score, reason FROM (
        SELECT vec_id, CASE WHEN label <> 3 THEN list_distance({_D}, reference) END AS d, CASE WHEN label = 3 THEN 'no_reference_embedding' END AS reason
        FROM embeddings LEFT JOIN centroids USING (label)) WHERE reason IS NULL
        UNION ALL SELECT vec_id, NULL, NULL, NULL, NULL, 'no_reference_embedding' FROM embeddings WHERE label = 3""", extra={"centroids": _CENTROIDS}))
def signature_verification(spark, folder):
    """Every vector against the centroid of its label; label 3 is not enrolled."""
    samples = vectors(spark, folder)
    references = verify.centroids(samples.where(F.col("label") != 3), ["label"]).withColumnRenamed("centroid", "reference")
    rows = verify.verify_signatures(samples, references, "label")
    return rows.select("vec_id", F.round("distance", 6).alias("distance"), F.round("similarity", 6).alias("similarity"), "match", "score", "reason")


@query("group_centroids", "F5", with_views(
    "SELECT label, generate_subscripts(reference, 1) AS dim, round(unnest(reference), 6) AS value FROM centroids", extra={"centroids": _CENTROIDS}))
def group_centroids(spark, folder):
    rows = verify.centroids(vectors(spark, folder), ["label"])
    return rows.select("label", F.posexplode("centroid").alias("p", "v")).select(
        "label", (F.col("p") + 1).cast("long").alias("dim"), F.round("v", 6).alias("value"))


@query("group_consistency", "F2 F4", f"""
    SELECT a.label, any_value(n) AS members, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS consistency
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) c ON c.label = a.label GROUP BY a.label""")
def group_consistency(spark, folder):
    return verify.mean_pairwise_cosine(vectors(spark, folder), ["label"]).withColumn("consistency", F.round("consistency", 6))


@query("enrolment_verdicts", "F10 F12", f"""
    SELECT p.photo_id, coalesce(members, 0) AS members, round(consistency, 6) AS consistency,
      CASE WHEN coalesce(members, 0) <> 3 THEN 'signature_count' WHEN consistency IS NULL OR consistency < 0.05 THEN 'signature_similarity' WHEN hard_flag THEN 'signature_edited' END AS reason,
      coalesce(members, 0) = 3 AND coalesce(consistency >= 0.05, FALSE) AND NOT hard_flag AS accepted
    FROM (SELECT vec_id // 3 AS photo_id, bool_or(vec_id % 7 = 0) AS hard_flag, count(*) AS members FROM embeddings GROUP BY 1) p
    LEFT JOIN (SELECT a.vec_id // 3 AS photo_id, avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS consistency
      FROM embeddings a JOIN embeddings b ON a.vec_id // 3 = b.vec_id // 3 AND a.vec_id < b.vec_id GROUP BY 1) USING (photo_id)""")
def enrolment_verdicts(spark, folder):
    """Photos of three samples; the gate is set to the data's own scale."""
    shots = vectors(spark, folder).withColumn("photo_id", F.floor(F.col("vec_id") / 3))
    edited = shots.select("photo_id", F.when(F.col("vec_id") % 7 == 0, F.array(F.lit("edited"))).alias("m"))
    reasons = forensics.enrolment_forensics(F.col("m"), F.array().cast("array<string>"))
    hard = edited.groupBy("photo_id").agg(F.bool_or(F.size(reasons) > 0).alias("hard_flag"))
    return verify.enrolment_verdicts(shots, hard, consistency=0.05).withColumn("consistency", F.round("consistency", 6))


_RAW = """SELECT vec_id, CASE vec_id % 8 WHEN 0 THEN '' WHEN 1 THEN '[]' WHEN 2 THEN '{"a": 1}' WHEN 3 THEN '[1.5, "x"]' WHEN 4 THEN '[0.5, 1.5]' WHEN 5 THEN NULL ELSE 'full' END AS raw, len(embedding) AS n FROM embeddings"""


@query("reference_vector_faults", "A5 F3", with_views(
    """SELECT vec_id, CASE WHEN raw IS NULL OR raw IN ('', '[]', '{"a": 1}') THEN 'not_a_non_empty_array' WHEN raw = '[1.5, "x"]' THEN 'not_numeric' WHEN raw = '[0.5, 1.5]' THEN 'wrong_length' WHEN n <> 64 THEN 'wrong_length' END AS fault FROM raws""",
    extra={"raws": _RAW}))
def reference_vector_faults(spark, folder):
    key = F.col("vec_id")
    raw = (F.when(key % 8 == 0, "").when(key % 8 == 1, "[]").when(key % 8 == 2, '{"a": 1}').when(key % 8 == 3, '[1.5, "x"]')
           .when(key % 8 == 4, "[0.5, 1.5]").when(key % 8 == 5, None).otherwise(F.to_json("embedding")))
    rows = D.table(spark, folder, "embeddings").select("vec_id", raw.alias("raw"))
    texts = F.from_json("raw", "array<string>")
    parsed = F.transform(texts, lambda x: x.try_cast("double"))
    return rows.select("vec_id", vector_fault(parsed, F.col("raw"), 64).alias("fault"))


_ISSUED = """SELECT vec_id, [5, 1, 6, 9][vec_id % 4 + 1] AS document_type_id, ['lgu', 'national', 'national', NULL][vec_id % 4 + 1] AS issuer_scope,
    CASE WHEN vec_id % 5 <> 0 THEN upper('nation_' || (vec_id % 12)) END AS city, embedding FROM embeddings"""
_HELD = """SELECT 5 AS document_type_id, 'Nation_' || label AS city, label AS reference_id, reference FROM centroids WHERE label < 8
    UNION ALL SELECT 1, '', label, reference FROM centroids WHERE label = 8"""


@query("stamp_verification", "B8 D7 F2 F7", with_views(
    f"""SELECT vec_id, reason, CASE WHEN reason IS NULL THEN round(sim, 6) END AS similarity_score, reason IS NULL AND sim >= 0.2 AS match, stamp_tampered FROM (
        SELECT i.vec_id, CASE WHEN issuer_scope IS NULL THEN 'no_issuer_logo' WHEN issuer_scope = 'lgu' AND i.city IS NULL THEN 'city_not_identified' WHEN h.reference_id IS NULL THEN 'unreferenced_logo' END AS reason,
          list_cosine_similarity({_D}, h.reference) AS sim, CASE WHEN vec_id % 3 <> 0 THEN (vec_id % 100) / 100.0::DOUBLE < 0.5 END AS stamp_tampered
        FROM issued i LEFT JOIN (SELECT * FROM held UNION ALL SELECT 6, '', label, reference FROM centroids WHERE label = 9) h ON h.document_type_id = i.document_type_id
          AND h.city = CASE issuer_scope WHEN 'lgu' THEN upper(substr(i.city, 1, 1)) || lower(substr(i.city, 2)) WHEN 'national' THEN '' END)""",
    extra={"centroids": _CENTROIDS, "issued": _ISSUED, "held": _HELD}))
def stamp_verification(spark, folder):
    key = F.col("vec_id")
    pick = lambda *x: F.get(F.array(*[F.lit(v) for v in x]), (key % 4).cast("int"))
    issued = vectors(spark, folder).select(
        "vec_id", "vector", pick(5, 1, 6, 9).alias("document_type_id"), pick("lgu", "national", "national", None).alias("issuer_scope"),
        F.when(key % 5 != 0, F.upper(F.concat(F.lit(" nation_"), key % 12))).alias("city"),
        F.when(key % 3 != 0, (key % 100) / 100.0).alias("genuine_probability"))
    means = verify.centroids(vectors(spark, folder), ["label"])
    local = means.where(F.col("label") < 8).select(F.lit(5).alias("document_type_id"), F.concat(F.lit("Nation_"), "label").alias("city"),
                                                  F.col("label").alias("reference_id"), F.col("centroid").alias("feature_vector"))
    national = means.where(F.col("label") == 8).select(F.lit(1).alias("document_type_id"), F.lit("").alias("city"),
                                                      F.col("label").alias("reference_id"), F.col("centroid").alias("feature_vector"))
    single = means.where(F.col("label") == 9).select(F.lit(6).alias("document_type_id"), F.col("label").alias("reference_id"), F.col("centroid").alias("feature_vector"))
    rows = verify.verify_stamps(verify.resolve_issuer(issued, local.unionByName(national), single), threshold=0.2)
    return rows.select("vec_id", "reason", F.round("similarity_score", 6).alias("similarity_score"), "match",
                       verify.texture_verdict(F.col("genuine_probability")).alias("stamp_tampered"))


_PAIRS = f"""SELECT round(list_distance({_D}, c.reference), 9) AS d, round(list_cosine_similarity({_D}, c.reference), 9) AS s, CASE WHEN c.label = e.label THEN 1 ELSE 0 END AS y
    FROM embeddings e JOIN centroids c ON c.label = e.label OR c.label = (e.label + 1) % 10"""


def _curve(column: str, accept: str) -> str:
    return f"""SELECT round(t, 6) AS threshold, far, frr FROM (SELECT i, t, sum(CASE WHEN y = 0 AND {column} {accept} t THEN 1 ELSE 0 END) / sum(CASE WHEN y = 0 THEN 1 ELSE 0 END) AS far,
        sum(CASE WHEN y = 1 AND NOT {column} {accept} t THEN 1 ELSE 0 END) / sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS frr
        FROM pairs, (SELECT i, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199.0::DOUBLE) END AS t FROM range(200) g(i), (SELECT min({column}) AS lo, max({column}) AS hi FROM pairs)) GROUP BY 1, 2)
        ORDER BY abs(far - frr), i LIMIT 1"""


def _eer_pairs(spark, folder):
    samples = vectors(spark, folder)
    means = verify.centroids(samples, ["label"]).select(F.col("label").alias("against"), "centroid")
    against = F.explode(F.array(F.col("label"), (F.col("label") + 1) % 10))
    joined = samples.select("label", "vector", against.alias("against")).join(means, "against")
    return joined.select(F.round(euclidean(F.col("vector"), F.col("centroid")), 9).alias("distance"),
                         F.round(cosine(F.col("vector"), F.col("centroid")), 9).alias("similarity"),
                         (F.col("label") == F.col("against")).cast("int").alias("label"))


@query("signature_threshold", "F13", with_views(_curve("d", "<="), extra={"centroids": _CENTROIDS, "pairs": _PAIRS}))
def signature_threshold(spark, folder):
    return verify.eer_threshold(_eer_pairs(spark, folder)).withColumn("threshold", F.round("threshold", 6))


@query("stamp_threshold", "F14", with_views(_curve("s", ">="), extra={"centroids": _CENTROIDS, "pairs": _PAIRS}))
def stamp_threshold(spark, folder):
    return verify.eer_threshold(_eer_pairs(spark, folder), "similarity", genuine_low=False).withColumn("threshold", F.round("threshold", 6))


@query("stamp_reference_similarity", "F14", with_views(
    f"""SELECT vec_id, round(list_cosine_similarity({_D}, reference), 6) AS similarity FROM embeddings JOIN trained USING (label)""",
    extra={"trained": _CENTROIDS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 5 <> 0)")}))
def stamp_reference_similarity(spark, folder):
    """Each crop against its asset's mean genuine training vector."""
    rows = vectors(spark, folder).withColumnRenamed("label", "asset").withColumn("label", (F.col("vec_id") % 5 != 0).cast("int"))
    scored = verify.similarity_to_group_reference(rows, rows, "asset")
    return scored.select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("texture_classifier", "F8 F9", with_views(
    """SELECT vec_id, round(p, 6) AS genuine_probability, p < 0.5 AS stamp_tampered, (p > 0.5) = (label < 5) AS correct, vec_id % 5 = 0 AS held_out FROM (
         SELECT vec_id, label, 1.0::DOUBLE / (1.0::DOUBLE + exp(-(list_dot_product([CAST(x AS DOUBLE) FOR x IN embedding], w) + bias))) AS p FROM embeddings,
           (SELECT list(one - zero ORDER BY i) AS w, sum(zero * zero - one * one) / 2 AS bias FROM gap))""",
    extra={"gap": """SELECT i, avg(x) FILTER (label < 5) AS one, avg(x) FILTER (label >= 5) AS zero FROM (
        SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings WHERE vec_id % 5 <> 0) GROUP BY 1"""}))
def texture_classifier(spark, folder):
    """Every vector scored with coefficients from four fifths of them; whether the
    verdict is right shows on the fifth that is held out."""
    rows = vectors(spark, folder)
    taught = rows.where(F.col("vec_id") % 5 != 0).select("vector", (F.col("label") < 5).cast("int").alias("label"))
    weights, bias = verify.class_gap(taught)
    scored = rows.withColumns({"w": weights, "b": bias}).withColumn("p", verify.logistic_score(F.col("vector"), F.col("w"), F.col("b")))
    return scored.select("vec_id", F.round("p", 6).alias("genuine_probability"), verify.texture_verdict(F.col("p")).alias("stamp_tampered"),
                         ((F.col("p") > 0.5) == (F.col("label") < 5)).alias("correct"), (F.col("vec_id") % 5 == 0).alias("held_out"))


@query("texture_training", "F9")
def texture_training(spark, folder):
    """Every vector scored by the classifier fitted on the ids whose hash modulo 5 is
    not 0, and the accuracy on the others. SQL can't state the fit."""
    out = F.pmod(F.xxhash64("vec_id"), F.lit(5)) == 0
    rows = vectors(spark, folder).withColumns({"label": (F.col("label") < 5).cast("int"), "held_out": out})
    model = verify.fit_texture(rows.where(~out), "vec_id")
    accuracy = verify.texture_accuracy(model, rows.where(out))
    p = model.score(F.col("vector"))
    return rows.withColumn("p", p).select(
        "vec_id", F.round("p", 6).alias("genuine_probability"), verify.texture_verdict(F.col("p")).alias("stamp_tampered"),
        ((F.col("p") > 0.5) == (F.col("label") == 1)).alias("correct"), "held_out", F.lit(accuracy).cast("double").alias("accuracy"))


def _pair_sql(n: int) -> str:
    h = lambda tag: f"('0x' || substr(md5(concat_ws('|', '{tag}', vec_id)), 1, 8))::BIGINT"
    arms = []
    for k in range(n):
        g = "FILTER (genuine)"
        first, near, far = (f"arg_min(vec_id, {h(f'a{k}')}) {g}", f"arg_min(vec_id, {h(f'b{k}')}) {g}", f"arg_max(vec_id, {h(f'b{k}')}) {g}")
        if k % 2 == 0:
            second = f"CASE WHEN {near} <> {first} THEN {near} ELSE {far} END"
        else:
            second = f"arg_min(vec_id, {h(f'f{k}')}) FILTER (NOT genuine)"
        arms.append(f"SELECT vendor, {k} AS k, {first} AS left_id, {second} AS right_id, {1 - k % 2} AS label FROM pool GROUP BY vendor")
    return "SELECT * FROM (" + " UNION ALL ".join(arms) + ") WHERE left_id IS NOT NULL AND right_id IS NOT NULL"


@query("training_pairs", "F15", with_views(_pair_sql(6), extra={
    "pool": "SELECT label AS vendor, vec_id, vec_id % 4 <> 0 AS genuine FROM embeddings"}))
def training_pairs(spark, folder):
    pool = vectors(spark, folder).select(F.col("label").alias("vendor"), "vec_id", (F.col("vec_id") % 4 != 0).alias("genuine"))
    return datasets.training_pairs(pool, "vendor", "vec_id", pairs=6)


_SHOTS = """SELECT document_id AS photo_id, page_index AS position, confidence, CASE WHEN ret = 'A' THEN 'signature' ELSE 'logo' END AS label, ret FROM pages_"""


@query("top_signature_boxes", "F11", page_sql(
    """SELECT photo_id, position, confidence, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY photo_id ORDER BY confidence DESC, position) AS rank FROM (
         SELECT * FROM shots WHERE ret = 'A' UNION ALL SELECT * FROM shots WHERE ret = 'N' AND photo_id NOT IN (SELECT photo_id FROM shots WHERE ret = 'A'))) WHERE rank <= 3""", {"shots": _SHOTS}))
def top_signature_boxes(spark, folder):
    rows = pages(spark, folder).select(F.col("document_id").alias("photo_id"), F.col("page_index").alias("position"), "confidence", "ret")
    primary = rows.where(F.col("ret") == "A").withColumn("label", F.lit("signature"))
    enhanced = rows.where(F.col("ret") == "N").withColumn("label", F.lit("signature"))
    return verify.top_signatures(primary, enhanced, limit=3).select("photo_id", "position", "confidence", "rank")


# --- forensics ---------------------------------------------------------------
_TECH = {"metadata": ("price % 6 <> 0", "(100 - price % 90) / 100.0"), "ela": ("part % 5 <> 0", "(100 - part % 80) / 100.0"),
         "copy_move": ("supp % 4 <> 0", "(100 - price % 97) / 100.0"), "font": ("qty % 3 <> 0", "(10 - qty % 10) / 10.0"),
         "cross_reference": ("disc % 2 = 0", "(100 - qty * 2) / 100.0")}
_WEIGHT = {"metadata": 0.2, "ela": 0.25, "copy_move": 0.25, "font": 0.15, "cross_reference": 0.15}


def _blend_sql() -> str:
    score = {n: f"CASE WHEN {c} THEN {e}::DOUBLE END" for n, (c, e) in _TECH.items()}
    num = " + ".join(f"CASE WHEN {n}_ IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE * (1.0::DOUBLE - {n}_) END" for n, w in _WEIGHT.items())
    den = " + ".join(f"CASE WHEN {n}_ IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for n, w in _WEIGHT.items())
    r4 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(20,9)), 4) AS DOUBLE)"
    missing = ", ".join(f"CASE WHEN {n}_ IS NULL THEN 'tamper_{n}_unavailable' END" for n in _WEIGHT)
    return page_sql(f"""SELECT document_id, page_index, {r4('t')} AS tamper_score, {r4('1.0 - t')} AS tamper_authenticity, {r4('s')} AS tamper_confidence, round(s, 9) >= 0.8 AS hard_flag,
        round(1.0 - t, 9) >= 0.5 AND NOT round(s, 9) >= 0.8 AS tamper_passed, array_to_string(list_filter([{missing}], lambda x: x IS NOT NULL), '; ') AS unavailable FROM (
        SELECT *, CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE 0 END AS t, greatest(0, coalesce(1.0::DOUBLE - metadata_, 0), coalesce(1.0::DOUBLE - copy_move_, 0)) AS s
        FROM (SELECT *, {', '.join(f'{e} AS {n}_' for n, e in score.items())} FROM pages_))""")


@query("tamper_blend", "E19 E36", _blend_sql())
def tamper_blend(spark, folder):
    named = pages(spark, folder).select("document_id", "page_index", *[
        F.expr(f"CASE WHEN {c} THEN CAST({e} AS DOUBLE) END").alias(f"{n}_") for n, (c, e) in _TECH.items()])
    scores = {n: F.col(f"{n}_") for n in _TECH}
    rows = forensics.blend(named, scores).withColumn("unavailable", F.array_join(forensics.unavailable_flags(scores), "; "))
    return rows.select("document_id", "page_index", "tamper_score", "tamper_authenticity", "tamper_confidence", "hard_flag", "tamper_passed", "unavailable")


WORD_VIEW = {"words": r"""SELECT doc_id AS page_id, CAST(pos AS INTEGER) AS pos, text, 30 + h % 70 AS conf, length(text) * (9 + h % 3) AS width,
    28 + h % 5 + CASE WHEN h % 211 = 0 THEN 40 + h % 17 ELSE 0 END AS height FROM (
    SELECT doc_id, pos, w AS text, ((pos * 7919 + doc_id * 104729) % 1000003 * 31 + pos) % 99991 AS h FROM (
      SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS ws FROM documents)))"""}


def words(spark, folder):
    """OCR words of each page with boxes: tokens of the document texts."""
    tokens = D.table(spark, folder, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "[ \n]+")).alias("pos", "text"))
    h = ((F.col("pos").cast("long") * 7919 + F.col("page_id") * 104729) % 1000003 * 31 + F.col("pos")) % 99991
    hashed = tokens.withColumn("h", h)
    return hashed.select("page_id", "pos", "text", (30 + F.col("h") % 70).alias("conf"), (F.length("text") * (9 + F.col("h") % 3)).alias("width"),
                         (28 + F.col("h") % 5 + F.when(F.col("h") % 211 == 0, 40 + F.col("h") % 17).otherwise(0)).alias("height"))


_FONT = {**WORD_VIEW,
    "samples": "SELECT *, CAST(height AS DOUBLE) AS h, width / length(trim(text)) AS w FROM words WHERE length(trim(text)) >= 3 AND conf >= 40 AND width > 0 AND height > 0",
    "centre": "SELECT page_id, count(*) AS n, median(h) AS hm, median(w) AS wm FROM samples GROUP BY 1 HAVING count(*) >= 6",
    "spread": "SELECT page_id, greatest(median(abs(h - hm)) * 1.4826::DOUBLE, hm * 0.05::DOUBLE) AS hs, greatest(median(abs(w - wm)) * 1.4826::DOUBLE, wm * 0.05::DOUBLE) AS ws FROM samples JOIN centre USING (page_id) GROUP BY page_id, hm, wm",
    "odd": """SELECT page_id, pos, text, CASE WHEN hz >= wz THEN 'height' ELSE 'spacing' END AS metric, CASE WHEN hz >= wz THEN h ELSE w END AS value FROM (
        SELECT *, abs(h - hm) / hs AS hz, abs(w - wm) / ws AS wz FROM samples JOIN centre USING (page_id) JOIN spread USING (page_id)) WHERE hz >= 3.5 OR wz >= 3.5""",
    "lone": """SELECT * FROM odd c WHERE NOT EXISTS (SELECT 1 FROM odd o WHERE o.page_id = c.page_id AND o.metric = c.metric AND o.pos <> c.pos AND abs(o.value - c.value) <= 0.20::DOUBLE * c.value)"""}


@query("font_outliers", "E32", with_views("SELECT page_id, pos, text, metric FROM lone", extra=_FONT))
def font_outliers(spark, folder):
    return forensics.font_outliers(forensics.font_samples(words(spark, folder))).select("page_id", "pos", "text", "metric")


@query("font_scores", "E32", with_views(
    """SELECT page_id, samples, coalesce(k, 0) AS outliers, CASE WHEN samples >= 6 THEN CAST(round(CAST(greatest(0.0, 1.0 - 0.3 * coalesce(k, 0)) AS DECIMAL(20,9)), 4) AS DOUBLE) END AS score
       FROM (SELECT page_id, count(*) FILTER (length(trim(text)) >= 3 AND conf >= 40 AND width > 0 AND height > 0) AS samples FROM words GROUP BY 1) LEFT JOIN (SELECT page_id, count(*) AS k FROM lone GROUP BY 1) USING (page_id)""", extra=_FONT))
def font_scores(spark, folder):
    samples = forensics.font_samples(words(spark, folder))
    return forensics.font_scores(samples, forensics.font_outliers(samples))


_CELLS = {"cells": """SELECT supp AS page_id, part % 24 AS cy, price % 20 AS cx, max(CASE WHEN qty >= 46 THEN 40 + qty ELSE qty / 10.0::DOUBLE END) AS err FROM pages_ GROUP BY 1, 2, 3""",
    "med": "SELECT page_id, median(err) AS m FROM cells GROUP BY 1",
    "mad": "SELECT page_id, any_value(m) AS m, median(abs(err - m)) AS d FROM cells JOIN med USING (page_id) GROUP BY 1",
    "hot": "SELECT page_id, cy, cx FROM cells JOIN mad USING (page_id) WHERE err > greatest(m + 6.0::DOUBLE * (d * 1.4826::DOUBLE), 10.0::DOUBLE)"}
_REACH = """WITH RECURSIVE {views}, reach(page_id, cy, cx, root) AS (
    SELECT page_id, cy, cx, cy * 4294967296 + cx FROM hot UNION
    SELECT h.page_id, h.cy, h.cx, r.root FROM reach r JOIN hot h ON h.page_id = r.page_id AND abs(h.cy - r.cy) <= 1 AND abs(h.cx - r.cx) <= 1),
  comps AS (SELECT page_id, cy, cx, min(root) AS comp FROM reach GROUP BY 1, 2, 3),
  regions AS (SELECT page_id, comp, count(*) AS blocks, min(cx) AS x0, min(cy) AS y0, max(cx) AS x1, max(cy) AS y1 FROM comps GROUP BY 1, 2 HAVING count(*) >= 4) """


def _reach_sql(body: str) -> str:
    inner = page_sql("SELECT 1", _CELLS)
    return _REACH.format(views=inner[len("WITH "):inner.rindex("SELECT 1")].rstrip()) + body


def cells(spark, folder):
    """Error cells per page (a supplier's page, a line item hits one cell)."""
    err = F.when(F.col("qty") >= 46, 40.0 + F.col("qty")).otherwise(F.col("qty") / 10.0)
    return pages(spark, folder).groupBy(F.col("supp").alias("page_id"), (F.col("part") % 24).alias("cy"), (F.col("price") % 20).alias("cx")).agg(F.max(err).alias("err"))


@query("error_regions", "E33", _reach_sql(
    "SELECT page_id, comp, blocks, x0 * 16 AS x, y0 * 16 AS y, (x1 - x0 + 1) * 16 AS w, (y1 - y0 + 1) * 16 AS h FROM regions"))
def error_regions(spark, folder):
    return forensics.error_regions(forensics.cell_components(forensics.hot_cells(cells(spark, folder))))


@query("error_scores", "E33", _reach_sql(
    """SELECT page_id, coalesce(n, 0) AS regions, CAST(round(CAST(coalesce(b, 0) / CAST(bh * bw AS DOUBLE) AS DECIMAL(20,9)), 4) AS DOUBLE) AS coverage,
       CAST(round(CAST(1.0 - least(0.8::DOUBLE, 0.25::DOUBLE * coalesce(n, 0) + 8.0::DOUBLE * (coalesce(b, 0) / CAST(bh * bw AS DOUBLE))) AS DECIMAL(20,9)), 4) AS DOUBLE) AS score
       FROM (SELECT page_id, max(cy) + 1 AS bh, max(cx) + 1 AS bw FROM cells GROUP BY 1) LEFT JOIN (SELECT page_id, count(*) AS n, CAST(sum(blocks) AS BIGINT) AS b FROM regions GROUP BY 1) USING (page_id)"""))
def error_scores(spark, folder):
    grid = cells(spark, folder)
    return forensics.error_scores(grid, forensics.error_regions(forensics.cell_components(forensics.hot_cells(grid))))


_POINTS = {"points": """SELECT supp AS page_id, document_id * 100000000 + page_index // 1000000000 % 100000000 AS kp, CAST(part * 37 % 1600 AS DOUBLE) AS x,
      CAST(part % 9 * 160 + part // 9 % 3 AS DOUBLE) AS y,      xor(('0x' || substr(md5('a' || part % 120), 1, 8))::BIGINT * 1073741824, price % 512) AS d0, ('0x' || substr(md5('b' || part % 120), 1, 8))::BIGINT * 1073741824 AS d1,
      xor(('0x' || substr(md5('c' || part % 120), 1, 8))::BIGINT * 1073741824, qty) AS d2, ('0x' || substr(md5('d' || part % 120), 1, 8))::BIGINT * 1073741824 AS d3 FROM pages_""",
    "near": """SELECT * FROM (SELECT a.page_id, a.kp, b.kp AS other, b.x - a.x AS dx, b.y - a.y AS dy,
        bit_count(xor(a.d0, b.d0)) + bit_count(xor(a.d1, b.d1)) + bit_count(xor(a.d2, b.d2)) + bit_count(xor(a.d3, b.d3)) AS dist FROM points a JOIN points b USING (page_id)) WHERE dist <= 40""",
    "best": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page_id, kp ORDER BY dist, other) AS rn FROM near) WHERE rn <= 3",
    "votes": """SELECT page_id, CAST(round_even(dx * s / 8, 0) * 8 AS BIGINT) AS ox, CAST(round_even(dy * s / 8, 0) * 8 AS BIGINT) AS oy, count(*) AS votes FROM (
        SELECT *, CASE WHEN dx < -dx OR (dx = -dx AND dy < -dy) THEN -1 ELSE 1 END AS s FROM best WHERE kp <> other AND sqrt(dx * dx + dy * dy) >= 16) GROUP BY 1, 2, 3"""}


def keypoints(spark, folder):
    """Keypoints per page: a supplier's page, a line item is a point; parts that
    share a pattern number have nearly equal descriptors."""
    part = F.col("part")
    word = lambda tag: hash32(F.concat(F.lit(tag), part % 120)) * 1073741824
    return pages(spark, folder).select(
        F.col("supp").alias("page_id"),
        (F.col("document_id") * 100000000 + F.expr("page_index div 1000000000 % 100000000")).alias("kp"),
        (part * 37 % 1600).cast("double").alias("x"), F.expr("CAST(part % 9 * 160 + part div 9 % 3 AS DOUBLE)").alias("y"),
        word("a").bitwiseXOR(F.col("price") % 512).alias("d0"), word("b").alias("d1"),
        word("c").bitwiseXOR(F.col("qty")).alias("d2"), word("d").alias("d3"))


@query("nearest_descriptors", "D13", page_sql("SELECT page_id, kp, CAST(dist AS INTEGER) AS dist, other, dx, dy FROM best", _POINTS))
def nearest_descriptors(spark, folder):
    return forensics.nearest_descriptors(keypoints(spark, folder))


@query("clone_scores", "E31", page_sql(
    """SELECT page_id, points, coalesce(v1, 0) AS top_votes, coalesce(v2, 0) AS runner_up, coalesce(competing, 0) AS competing, coalesce(c, FALSE) AS cloned,
       CAST(round(CAST(CASE WHEN c THEN 1.0 - least(0.85, 0.4 + 0.03 * (v1 - 12)) ELSE 1.0 END AS DECIMAL(20,9)), 4) AS DOUBLE) AS score FROM (
       SELECT *, points >= 24 AND v1 >= 12 AND NOT (competing >= 3 OR v1 < 2 * coalesce(v2, 0)) AS c FROM (SELECT page_id, count(*) AS points FROM points GROUP BY 1)
       LEFT JOIN (SELECT page_id, max(votes) FILTER (rn = 1) AS v1, max(votes) FILTER (rn = 2) AS v2, count(*) FILTER (votes >= 12) AS competing FROM (
         SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY votes DESC, ox, oy) AS rn FROM votes) GROUP BY 1) USING (page_id))""", _POINTS))
def clone_scores(spark, folder):
    points = keypoints(spark, folder)
    return forensics.clone_scores(points, forensics.offset_votes(forensics.nearest_descriptors(points))).drop("ox", "oy")


_CLONED = """SELECT page_id, v1, ox, oy FROM (SELECT page_id, count(*) AS points FROM points GROUP BY 1) JOIN (SELECT page_id, max(votes) FILTER (rn = 1) AS v1, max(votes) FILTER (rn = 2) AS v2,
    max(ox) FILTER (rn = 1) AS ox, max(oy) FILTER (rn = 1) AS oy, count(*) FILTER (votes >= 12) AS competing FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY votes DESC, ox, oy) AS rn FROM votes) GROUP BY 1) USING (page_id)
    WHERE points >= 24 AND v1 >= 12 AND NOT (competing >= 3 OR v1 < 2 * coalesce(v2, 0))"""


@query("font_flags", "E32", with_views("""SELECT page_id, pos, 'Font mismatch on field ' || CASE WHEN contains(text, chr(39)) AND NOT contains(text, '"') THEN '"' || replace(text, chr(92), chr(92) || chr(92)) || '"'
    ELSE chr(39) || replace(replace(text, chr(92), chr(92) || chr(92)), chr(39), chr(92) || chr(39)) || chr(39) END || ' (' || metric || ')' AS flag FROM lone""", extra=_FONT))
def font_flags(spark, folder):
    return forensics.font_flags(forensics.font_outliers(forensics.font_samples(words(spark, folder))))


@query("error_flags", "E33", _reach_sql(
    """SELECT page_id, CAST(pos AS INTEGER) AS pos, 'ELA: anomalous compression region at [' || x0 * 16 || ', ' || y0 * 16 || ', ' || (x1 - x0 + 1) * 16 || ', ' || (y1 - y0 + 1) * 16 || ']' AS flag
       FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY comp) - 1 AS pos FROM regions) WHERE pos < 4"""))
def error_flags(spark, folder):
    return forensics.error_flags(forensics.error_regions(forensics.cell_components(forensics.hot_cells(cells(spark, folder)))))


@query("clone_flags", "E31", page_sql("SELECT page_id, 0 AS pos, 'Copy-move: ' || v1 || ' cloned keypoints at offset [' || ox || ', ' || oy || ']' AS flag FROM cloned", {**_POINTS, "cloned": _CLONED}))
def clone_flags(spark, folder):
    points = keypoints(spark, folder)
    return forensics.clone_flags(forensics.clone_scores(points, forensics.offset_votes(forensics.nearest_descriptors(points))))


@query("metadata_checks", "B12 E34 G10", with_views(
    """SELECT document_id, CAST(round(CAST(greatest(0.0, 1.0 - (CASE WHEN editor IS NOT NULL THEN 0.6 ELSE 0 END + CASE WHEN later THEN 0.3 ELSE 0 END + CASE WHEN after THEN 0.5 ELSE 0 END)) AS DECIMAL(20,9)), 4) AS DOUBLE) AS score, editor,
       array_to_string(list_filter([CASE WHEN editor IS NOT NULL THEN 'File last written by an image editor (''' || editor || ''') — not an issuing/scanning system' END,
         CASE WHEN later THEN 'Last-modified (' || strftime(modified, '%Y-%m-%d') || ') is after creation (' || strftime(created, '%Y-%m-%d') || ')' END,
         CASE WHEN after THEN 'File modified (' || strftime(modified, '%Y-%m-%d') || ') after the document''s printed issue date (' || strftime(issued, '%Y-%m-%d') || ')' END], lambda x: x IS NOT NULL), '; ') AS flags FROM (
       SELECT *, coalesce(modified > created, FALSE) AS later, coalesce(CAST(modified AS DATE) > CAST(issued AS DATE), FALSE) AS after FROM (
         SELECT o_orderkey AS document_id, CASE o_orderkey % 6 WHEN 0 THEN 'photoshop' WHEN 3 THEN 'gimp' WHEN 4 THEN 'adobe' END AS editor,
           CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + INTERVAL 9 HOUR END AS created,
           CASE o_orderkey % 4 WHEN 3 THEN CAST(NULL AS TIMESTAMP) WHEN 2 THEN date_trunc('day', o_orderdate + to_days(CAST(o_custkey % 9 - 4 AS INTEGER))) ELSE o_orderdate + to_days(CAST(o_custkey % 9 - 4 AS INTEGER)) + INTERVAL 10 HOUR END AS modified,
           CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + INTERVAL 2 DAY END AS issued FROM orders))"""))
def metadata_checks(spark, folder):
    rows = forensics.metadata_checks(_provenance(D.table(spark, folder, "orders")))
    return rows.select("document_id", "score", "editor", F.array_join("flags", "; ").alias("flags"))


def _provenance(orders):
    """Provenance fields of a file per row of (o_orderkey, o_custkey, o_orderdate)."""
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    tools = F.get(F.array(*[F.lit(x) for x in ("Adobe Photoshop 25", "HP Scan", None, "GIMP 2.10", "Adobe PDF Library", "Canon iR")]), (key % 6).cast("int"))
    changed = day + F.make_dt_interval((F.col("o_custkey") % 9 - 4).cast("int"), F.lit(10))
    modified = (F.when(key % 4 == 0, F.date_format(changed, "yyyy-MM-dd'T'HH:mm:ss'+08:00'"))
                .when(key % 4 == 1, F.concat(F.lit("D:"), F.date_format(changed, "yyyyMMddHHmmss"), F.lit("+05'00'")))
                .when(key % 4 == 2, F.date_format(changed, "yyyy-MM-dd")).otherwise("unknown"))
    created = F.when(key % 11 != 0, F.date_format(day + F.expr("INTERVAL 9 HOURS"), "yyyy:MM:dd HH:mm:ss"))
    issued = F.when(key % 7 != 0, F.date_format(day + F.expr("INTERVAL 2 DAYS"), "yyyy-MM-dd")).otherwise("MAR 2017")
    return orders.select(
        key.alias("document_id"), tools.alias("software"), F.lit(None).cast("string").alias("producer"), created.alias("create_date"),
        modified.alias("modify_date"), issued.alias("issue_date"))


_PHOTOS = "(SELECT s_suppkey AS o_orderkey, s_nationkey AS o_custkey, TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 300 AS INTEGER)) AS o_orderdate FROM supplier)"


@query("enrolment_reasons", "F12 E31 E34", page_sql(f"""SELECT photo_id, concat_ws('; ', nullif(m.flags, ''), c.flag) AS reasons, m.flags <> '' OR c.flag IS NOT NULL AS hard_flag FROM (
    SELECT document_id AS photo_id, flags FROM ({STATEMENTS["metadata_checks"].replace("FROM orders", "FROM " + _PHOTOS)})) m
    LEFT JOIN (SELECT page_id AS photo_id, 'Copy-move: ' || v1 || ' cloned keypoints at offset [' || ox || ', ' || oy || ']' AS flag FROM cloned) c USING (photo_id)""", {**_POINTS, "cloned": _CLONED}))
def enrolment_reasons(spark, folder):
    """Reasons against every enrolment photo (a supplier's) from its file's provenance
    and its keypoints; any one fails it."""
    day = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("s_suppkey") % 300).cast("int"))
    photos = D.table(spark, folder, "supplier").select(F.col("s_suppkey").alias("o_orderkey"), F.col("s_nationkey").alias("o_custkey"), day.alias("o_orderdate"))
    read = forensics.metadata_checks(_provenance(photos)).select(F.col("document_id").alias("photo_id"), "flags")
    points = keypoints(spark, folder)
    cloned = forensics.clone_flags(forensics.clone_scores(points, forensics.offset_votes(forensics.nearest_descriptors(points))))
    both = read.join(cloned.select(F.col("page_id").alias("photo_id"), F.array("flag").alias("cloned")), "photo_id", "left")
    reasons = forensics.enrolment_forensics(F.col("flags"), F.coalesce("cloned", F.array().cast("array<string>")))
    return both.select("photo_id", F.array_join(reasons, "; ").alias("reasons"), (F.size(reasons) > 0).alias("hard_flag"))


def _document_tamper_sql() -> str:
    techniques = {"metadata": 0.2, "ela": 0.25, "copy_move": 0.25, "font": 0.15, "cross_reference": 0.15}
    num = " + ".join(f"CASE WHEN {n}_ IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE * (1.0::DOUBLE - {n}_) END" for n, w in techniques.items())
    den = " + ".join(f"CASE WHEN {n}_ IS NULL THEN 0.0::DOUBLE ELSE {w}::DOUBLE END" for n, w in techniques.items())
    r4 = lambda x: f"CAST(round(CAST({x} AS DECIMAL(20,9)), 4) AS DOUBLE)"
    part = lambda name, key, n: f"LEFT JOIN (SELECT {key} AS doc_id, score AS {n}_ FROM ({STATEMENTS[name]})) USING (doc_id)"
    return f"""SELECT doc_id, {r4('t')} AS tamper_score, {r4('1.0 - t')} AS tamper_authenticity, {r4('s')} AS tamper_confidence, round(s, 9) >= 0.8 AS hard_flag,
        round(1.0 - t, 9) >= 0.5 AND NOT round(s, 9) >= 0.8 AS tamper_passed FROM (
        SELECT *, CASE WHEN {den} > 0 THEN ({num}) / ({den}) ELSE 0 END AS t, greatest(0, coalesce(1.0::DOUBLE - metadata_, 0), coalesce(1.0::DOUBLE - copy_move_, 0)) AS s FROM (
        SELECT * FROM (SELECT doc_id FROM documents) {part("metadata_checks", "document_id", "metadata")} {part("error_scores", "page_id", "ela")} {part("clone_scores", "page_id", "copy_move")}
        {part("font_scores", "page_id", "font")} {part("identifier_checks", "-page_id - 1", "cross_reference")}))"""


@query("document_tamper", "E19 E31 E32 E33 E34 E35", _document_tamper_sql())
def document_tamper(spark, folder):
    """The verdict of every document over the results of all five techniques, joined
    on its id; a technique without a result for it is left out of the blend."""
    results = {"metadata": ("metadata_checks", F.col("document_id")), "ela": ("error_scores", F.col("page_id")), "copy_move": ("clone_scores", F.col("page_id")),
               "font": ("font_scores", F.col("page_id")), "cross_reference": ("identifier_checks", -F.col("page_id") - 1)}
    rows = D.table(spark, folder, "documents").select("doc_id")
    for technique, (name, key) in results.items():
        rows = rows.join(QUERIES[name](spark, folder).select(key.alias("doc_id"), F.col("score").alias(f"{technique}_")), "doc_id", "left")
    verdicts = forensics.blend(rows, {n: F.col(f"{n}_") for n in results})
    return verdicts.select("doc_id", "tamper_score", "tamper_authenticity", "tamper_confidence", "hard_flag", "tamper_passed")
