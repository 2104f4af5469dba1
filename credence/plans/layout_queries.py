"""Registered queries: word boxes, regions, intake and data-set preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions import text as T
from credence.operators import datasets, extraction, layout
from credence.plans import domain as D
from credence.plans.domain_sql import quoted, with_views
from credence.plans.page_queries import pages, sql as page_sql
from credence.plans.printed import RECORDS, records
from credence.plans.registry import query
from credence.session import spread, stored
from credence.sources import intake

# --- a two-column form laid out from the records: (field, text, left, top) ------
_CAPTIONS = [("c1", "TIN", 40, 100), ("c2", "NAME", 300, 100), ("c3", "REGISTRATION DATE", 900, 100), ("c4", "REGISTERED ADDRESS", 40, 220),
             ("c5", "TAX TYPE", 40, 340), ("c6", "TRADE NAME", 40, 460), ("c7", "LINE OF BUSINESS", 900, 460), ("c8", "REVENUE DISTRICT OFFICER", 700, 900)]
_VALUES = [("tin", 40, 140), ("registered_name", 300, 140), ("registration_date", 900, 140), ("registered_address", 40, 260), ("tax_types", 40, 390),
           ("trade_name", 40, 530), ("line_of_business", 900, 530), ("revenue_district_officer", 700, 850)]


def form_words(spark, folder):
    """Word boxes of one printed form per customer; every seventh form carries a
    misread caption. Forms are dealt evenly by page before their words are laid out, so
    what groups a page's words needs no shuffle of them."""
    record = spread(records(spark, folder, "bir"), "k")
    caption = lambda text: F.when(F.col("k") % 7 == 0, F.replace(F.lit(text), F.lit("REGISTRATION"), F.lit("REGISTRAUION"))).otherwise(text)
    parts = [(F.lit(i), caption(text), left, top) for i, (_, text, left, top) in enumerate(_CAPTIONS)]
    parts += [(F.lit(len(_CAPTIONS) + i), F.col(name), left, top) for i, (name, left, top) in enumerate(_VALUES)]
    lines = F.array(*[F.struct(n.alias("line"), t.alias("body"), F.lit(x).alias("x"), F.lit(y).alias("top")) for n, t, x, y in parts])
    rows = record.select(F.col("k").alias("page_id"), F.inline(lines))
    tokens = rows.select("page_id", "line", "x", "top", F.posexplode(F.split("body", " ")).alias("i", "text"))
    return tokens.select("page_id", (F.col("line") * 100 + F.col("i")).alias("slot"), "text", (F.col("x") + F.col("i") * 60).alias("left"), "top",
                         F.lit(50).alias("width"), F.lit(30).alias("height"), (F.col("line") * 20 + F.col("i")).alias("pos"))


_FORM = {"form": "SELECT page_id, line * 20 + i AS pos, text, x + i * 60 AS left_, top, 50 AS width, 30 AS height FROM (SELECT page_id, line, x, top, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS i FROM (SELECT page_id, line, x, top, string_split(body, ' ') AS ws FROM ("
    + " UNION ALL ".join(
        [f"SELECT k AS page_id, {i} AS line, CASE WHEN k % 7 = 0 THEN replace({quoted(t)}, 'REGISTRATION', 'REGISTRAUION') ELSE {quoted(t)} END AS body, {x} AS x, {y} AS top FROM bir" for i, (_, t, x, y) in enumerate(_CAPTIONS)]
        + [f"SELECT k, {len(_CAPTIONS) + i}, {n}, {x}, {y} FROM bir" for i, (n, x, y) in enumerate(_VALUES)]) + ")))"}


@query("caption_boxes", "D11", with_views(
    """SELECT page_id, 'date' AS phrase, CAST(min(pos) AS INTEGER) AS start, CAST(arg_min(left_, pos) AS INTEGER) AS left, CAST(arg_min(top, pos) AS INTEGER) AS top, CAST(arg_min(greatest(left_ + width, nl + width), pos) AS INTEGER) AS right, CAST(arg_min(top + height, pos) AS INTEGER) AS bottom FROM (
         SELECT *, lead(text) OVER w AS nt, lead(pos) OVER w AS np, lead(left_) OVER w AS nl FROM form WINDOW w AS (PARTITION BY page_id ORDER BY pos))
       WHERE np = pos + 1 AND levenshtein(text, 'REGISTRATION') <= least(4, least(length(text), 12) - 1) AND levenshtein(nt, 'DATE') <= least(4, least(length(nt), 4) - 1) GROUP BY 1""",
    extra={"bir": RECORDS["bir"], **_FORM}))
def caption_boxes(spark, folder):
    return layout.find_phrases(form_words(spark, folder), {"date": ("REGISTRATION DATE", 4)})


@query("positional_fields", "D10 G7 I9", with_views(
    " UNION ALL ".join(f"SELECT k AS page_id, '{n}' AS field_key, {v} AS value FROM bir" for n, v in (
        ("registered_name", "registered_name"), ("trade_name", "trade_name"), ("line_of_business", "line_of_business"),
        ("tax_types", "replace(tax_types, ',', '')"), ("revenue_district_officer", "revenue_district_officer"))), extra={"bir": RECORDS["bir"]}))
def positional_fields(spark, folder):
    """What the columns of a form say equals the record it was laid out from."""
    return layout.positional_fields(form_words(spark, folder))


_READ = " UNION ALL ".join(f"SELECT k AS page_id, '{n}' AS field_key, {n} AS value FROM bir" for n in ("trade_name", "registered_name"))


@query("positional_override", "I10", with_views(
    """SELECT page_id, field_key, value, CAST(round(CAST(avg(m) AS DECIMAL(20,9)), 1) AS DOUBLE) AS confidence FROM (
         SELECT page_id, field_key, value, regexp_replace(upper(unnest(string_split(value, ' '))), '[^A-Z0-9]', '', 'g') AS token FROM read_) JOIN tokmean USING (page_id, token) GROUP BY 1, 2, 3
       UNION ALL SELECT k, 'tin', 'typed', 12.5 FROM bir""",
    extra={"bir": RECORDS["bir"], **_FORM, "read_": _READ, "tokmean": """SELECT page_id, token, avg(conf) AS m FROM (
        SELECT page_id, 45 + (pos * 37 + page_id * 101) % 55 AS conf, regexp_replace(upper(text), '[^A-Z0-9]', '', 'g') AS token FROM form) WHERE token <> '' GROUP BY 1, 2"""}))
def positional_override(spark, folder):
    """Typed values of a form, replaced where the position says more."""
    typed = D.table(spark, folder, "customer").select(F.col("c_custkey").alias("page_id"), F.explode(F.array(
        F.lit("tin"), F.lit("trade_name"), F.lit("registered_name"))).alias("field_key")).select(
        "page_id", "field_key", F.lit("typed").alias("value"), F.lit(True).alias("matched"), F.lit(12.5).alias("confidence"))
    form = form_words(spark, folder)
    words = form.withColumn("conf", 45 + (F.col("pos").cast("long") * 37 + F.col("page_id") * 101) % 55)
    placed = stored(layout.positional_fields(form))  # read twice
    merged = extraction.merge_positional(typed, placed, words)
    return merged.select("page_id", "field_key", "value", "confidence")


# --- regions ---------------------------------------------------------------------
_ROI_FIELDS = [("tin", 0.0, 0.0, 0.3, 0.4), ("trade_name", 0.25, 0.2, 0.4, 0.5), ("date_issued", 0.6, 0.5, 0.4, 0.5)]


def _roi_config(spark, folder):
    """A configuration file per nation: two plain templates and one city each."""
    nation = D.table(spark, folder, "nation")
    body = lambda shift: F.concat(F.lit("{"), F.concat_ws(",", *[F.format_string(
        f'"{n}":{{"x":%s,"y":{y},"w":{w},"h":{h}}}', (F.lit(x) + shift).cast("string")) for n, x, y, w, h in _ROI_FIELDS]), F.lit("}"))
    key = F.col("n_nationkey")
    plain = F.when(key == 0, F.concat(F.lit('{"bir":'), body(F.lit(0.0)), F.lit(',"dti":'), body(F.lit(0.05)), F.lit(',"business_permit":{"nation_0":'), body(F.lit(0.0)), F.lit("}}")))
    city = F.concat(F.lit('{"business_permit":{"'), F.lower("n_name"), F.lit('":'), body(F.round(key * 0.004, 3)), F.lit("}}"))
    return intake.roi_table(nation.select(F.coalesce(plain, city).alias("raw")))


_ROI_SQL = {"rois": " UNION ALL ".join(
    [f"SELECT '{t}' AS template, '' AS city, '{n}' AS field_key, {x}::DOUBLE + {s}::DOUBLE AS x, {y}::DOUBLE AS y, {w}::DOUBLE AS w, {h}::DOUBLE AS h" for t, s in (("bir", 0.0), ("dti", 0.05)) for n, x, y, w, h in _ROI_FIELDS]
    + [f"SELECT 'business_permit', lower(n_name), '{n}', {x}::DOUBLE + round(n_nationkey * 0.004::DOUBLE, 3), {y}::DOUBLE, {w}::DOUBLE, {h}::DOUBLE FROM nation" for n, x, y, w, h in _ROI_FIELDS])}


@query("roi_table", "A9", with_views("SELECT * FROM rois", extra=_ROI_SQL))
def roi_table(spark, folder):
    return _roi_config(spark, folder)


_BOX_SQL = {"boxes": "SELECT document_id, page_index AS box_id, CAST(part % 900 AS DOUBLE) AS l, CAST(price % 700 AS DOUBLE) AS t, CAST(10 + supp % 80 AS DOUBLE) AS w_, CAST(qty AS DOUBLE) AS h_ FROM pages_",
    "sheets_": """SELECT o_orderkey AS document_id, ['bir', 'dti', 'business_permit'][o_orderkey % 3 + 1] AS template, CASE WHEN o_orderkey % 5 <> 0 THEN lower(n_name) END AS city FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
    "hits": """SELECT b.document_id AS page_id, r.field_key, l, t, w_, h_ FROM boxes b JOIN sheets_ s USING (document_id) JOIN rois r ON r.template = s.template AND r.city = CASE WHEN s.template = 'business_permit' THEN s.city ELSE '' END
      WHERE greatest(0, least(l + w_, r.x * 1000 + r.w * 1000) - greatest(l, r.x * 1000)) * greatest(0, least(t + h_, r.y * 800 + r.h * 800) - greatest(t, r.y * 800)) / (w_ * h_) >= 0.5"""}


def _matched(spark, folder):
    boxes = pages(spark, folder).select(
        F.col("document_id").alias("page_id"), (F.col("part") % 900).cast("double").alias("left"), (F.col("price") % 700).cast("double").alias("top"),
        (10 + F.col("supp") % 80).cast("double").alias("width"), F.col("qty").cast("double").alias("height"))
    names = F.array(F.lit("bir"), F.lit("dti"), F.lit("business_permit"))
    places = D.table(spark, folder, "customer").join(D.table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    key = F.col("o_orderkey")
    sheets = D.table(spark, folder, "orders").join(places, F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("page_id"), F.get(names, (key % 3).cast("int")).alias("template"),
        F.when(key % 5 != 0, F.concat(F.lit("City of  "), "n_name")).alias("city"), F.lit(1000).alias("page_width"), F.lit(800).alias("page_height"))
    return layout.match_rois(boxes, layout.page_rois(sheets, _roi_config(spark, folder)))


@query("roi_matches", "B23 D9 D12", page_sql(
    "SELECT page_id, field_key, min(l) AS x, min(t) AS y, max(l + w_) - min(l) AS w, max(t + h_) - min(t) AS h, count(*) AS boxes FROM hits GROUP BY 1, 2", {**_ROI_SQL, **_BOX_SQL}))
def roi_matches(spark, folder):
    return _matched(spark, folder)


_KNOWN = """SELECT page_id, field_key, x, boxes, CASE field_key WHEN 'tin' THEN 0 WHEN 'trade_name' THEN 1 ELSE 2 END AS ord, page_id % 4 <> 0 AS matched, CASE WHEN page_id % 3 <> 0 THEN 60 + (page_id * 7 + length(field_key)) % 40 END AS confidence, field_key <> 'tin' AS required
    FROM (SELECT page_id, field_key, min(l) AS x, count(*) AS boxes FROM hits GROUP BY 1, 2)"""


@query("recognition_budget", "G8 G9", page_sql(
    """SELECT page_id, field_key, CAST(priority AS INTEGER) AS priority, CASE WHEN coalesce(sum(cost) OVER (PARTITION BY page_id ORDER BY priority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 210000 THEN 'recognized' ELSE 'skipped_over_budget' END AS outcome FROM (
       SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY required DESC, ord) AS priority, boxes * 90000 + page_id % 7 * 1000 AS cost FROM known WHERE NOT coalesce(matched AND confidence >= 90, FALSE))""",
    {**_ROI_SQL, **_BOX_SQL, "known": _KNOWN}))
def recognition_budget(spark, folder):
    found = _matched(spark, folder)
    place = F.when(F.col("field_key") == "tin", 0).when(F.col("field_key") == "trade_name", 1).otherwise(2)
    matched = found.select("page_id", "field_key", place.alias("ord"), (F.col("boxes") * 90000 + F.col("page_id") % 7 * 1000).alias("cost_ms"))
    key = F.col("page_id")
    fields = matched.select("page_id", "field_key", (key % 4 != 0).alias("matched"),
                            F.when(key % 3 != 0, 60 + (key * 7 + F.length("field_key")) % 40).alias("confidence"), (F.col("field_key") != "tin").alias("required"))
    ordered = layout.recognition_order(matched, fields)
    return layout.within_budget(ordered).select("page_id", "field_key", "priority", "outcome")


@query("boxes_out_of_bounds", "L13", page_sql("SELECT document_id, box_id FROM boxes WHERE l + w_ > 900 OR t + h_ > 690", _BOX_SQL))
def boxes_out_of_bounds(spark, folder):
    rows = pages(spark, folder).select("document_id", F.col("page_index").alias("box_id"), (F.col("part") % 900).alias("x"), (F.col("price") % 700).alias("y"),
                                       (10 + F.col("supp") % 80).alias("w"), F.col("qty").alias("h"))
    return layout.boxes_out_of_bounds(rows, 900, 690).select("document_id", "box_id")


@query("label_slugs", "L13", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_name || ' -/- No.' || p_size || ' ')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def label_slugs(spark, folder):
    label = F.concat(F.col("p_name"), F.lit(" -/- No."), F.col("p_size"), F.lit(" "))
    return D.table(spark, folder, "part").select("p_partkey", T.label_slug(label).alias("slug"))


# --- intake ----------------------------------------------------------------------
_UPLOADS = {"uploads": """SELECT doc_id, 'scan-' || doc_id || ['.pdf', '.PNG', '.jpg', '.jpeg', '.gif', ''][doc_id % 6 + 1] AS filename,
    ['application/pdf', 'image/png', 'image/jpeg', 'image/jpeg', 'image/gif', 'text/plain'][CASE WHEN doc_id % 17 = 0 THEN (doc_id + 1) % 6 ELSE doc_id % 6 END + 1] AS declared,
    CASE WHEN doc_id % 13 = 0 THEN '' ELSE ['255044462D', '89504E470D0A1A0A', 'FFD8FF', 'FFD8FF', '474946', '00'][CASE WHEN doc_id % 19 = 0 THEN (doc_id + 2) % 6 ELSE doc_id % 6 END + 1] END AS head,
    CASE WHEN doc_id % 13 = 0 THEN 0 ELSE strlen(text) END AS bytes FROM documents"""}


@query("upload_rejections", "A2", with_views(
    """SELECT doc_id, CASE WHEN expected IS NULL THEN 'unsupported_type' WHEN declared <> expected THEN 'mime_mismatch' WHEN bytes = 0 THEN 'empty_file'
       WHEN head <> magic THEN 'content_mismatch' END AS reason FROM (SELECT *, CASE doc_id % 6 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' WHEN 3 THEN 'image/jpeg' END AS expected,
         CASE doc_id % 6 WHEN 0 THEN '255044462D' WHEN 1 THEN '89504E470D0A1A0A' ELSE 'FFD8FF' END AS magic FROM uploads)""", extra=_UPLOADS))
def upload_rejections(spark, folder):
    """Uploads whose bytes are a type's magic number followed by the document."""
    k = F.col("doc_id")
    choose = lambda values, at: F.get(F.array(*[F.lit(v) for v in values]), at.cast("int"))
    name = F.concat(F.lit("scan-"), k, choose([".pdf", ".PNG", ".jpg", ".jpeg", ".gif", ""], k % 6))
    declared = choose(["application/pdf", "image/png", "image/jpeg", "image/jpeg", "image/gif", "text/plain"], F.when(k % 17 == 0, (k + 1) % 6).otherwise(k % 6))
    magic = F.unhex(choose(["255044462D", "89504E470D0A1A0A", "FFD8FF", "FFD8FF", "474946", "00"], F.when(k % 19 == 0, (k + 2) % 6).otherwise(k % 6)))
    content = F.when(k % 13 == 0, F.lit(b"")).otherwise(F.concat(magic, F.encode("text", "UTF-8")))
    rows = D.table(spark, folder, "documents").select("doc_id", name.alias("filename"), declared.alias("declared"), content.alias("content"))
    return rows.select("doc_id", intake.reject_reason(F.col("filename"), F.col("declared"), F.col("content"), F.length("content")).alias("reason"))


@query("first_pages", "A3", "SELECT conv_id, turn, role FROM conversations WHERE turn + 1 <= 2")
def first_pages(spark, folder):
    turns = D.table(spark, folder, "conversations").withColumn("page_index", F.col("turn") + 1)
    return intake.first_pages(turns).select("conv_id", "turn", "role")


@query("batch_faults", "A4", with_views(
    "SELECT submission_id, CAST(sum(file_size_bytes) AS BIGINT) AS total_bytes, count(*) FILTER (extension NOT IN ('pdf', 'png')) AS wrong_formats, sum(file_size_bytes) > 5 * 1024 * 1024 AS too_large FROM documents GROUP BY 1", "documents"))
def batch_faults(spark, folder):
    return intake.batch_faults(D.documents(spark, folder), max_batch_mb=5, accepted="pdf,png")


@query("reference_map", "A6", """
    SELECT region_id, city, value FROM (SELECT c_nationkey AS region_id, city, arg_max(v, pos) AS value FROM (SELECT c_nationkey, unnest([{'city': 'Lapu-Lapu', 'v': c_custkey + 0.5::DOUBLE, 'pos': 0}, {'city': '', 'v': c_custkey + 1.5::DOUBLE, 'pos': 1},
      {'city': 'Lapu-Lapu', 'v': c_custkey + 2.5::DOUBLE, 'pos': 2}], recursive := true), c_custkey FROM customer) GROUP BY c_nationkey, c_custkey, city)""")
def reference_map(spark, folder):
    k = F.col("c_custkey")
    raw = F.format_string('{"lapu-lapu":[%d.5],"  ":[%d.5],"LAPU-LAPU ":[%d.5]}', k, k + 1, k + 2)
    rows = D.table(spark, folder, "customer").select(F.col("c_nationkey").alias("region_id"), F.inline(intake.parse_reference_map(raw)))
    return rows.select("region_id", "city", F.get("vector", 0).alias("value"))


# --- data sets -------------------------------------------------------------------
_FILES = {"files": """SELECT p_partkey, p_type AS class, 'item_' || lpad(CAST(p_partkey // 2 AS VARCHAR), 5, '0') AS group_stem, CASE WHEN p_partkey % 2 = 0 THEN 'clean' ELSE 'scan' END AS variant FROM part"""}


def _files(spark, folder):
    k = F.col("p_partkey")
    path = F.concat(F.lit("data/val/"), "p_type", F.lit("/item_"), F.lpad(F.expr("p_partkey div 2").cast("string"), 5, "0"),
                    F.when(k % 2 == 0, "_clean.png").otherwise("_scan.jpg"))
    return D.table(spark, folder, "part").select("p_partkey", path.alias("path")).withColumns(intake.labelled_file(F.col("path")))


@query("group_safe_split", "A10 L7", with_views(
    """SELECT p_partkey, f.class, f.group_stem, variant, CASE WHEN r <= n // 2 THEN 'test' ELSE 'val' END AS split FROM files f JOIN (
       SELECT class, group_stem, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || group_stem), group_stem) AS r, count(*) OVER (PARTITION BY class) AS n FROM (SELECT DISTINCT class, group_stem FROM files)) s
       ON s.class = f.class AND s.group_stem = f.group_stem""", extra=_FILES))
def group_safe_split(spark, folder):
    return datasets.group_safe_split(_files(spark, folder)).select("p_partkey", "class", "group_stem", "variant", "split")


@query("split_counts", "L8 L12", "SELECT grp AS \"group\", n, n - val AS train, val FROM (SELECT *, CASE WHEN n > 1 THEN greatest(1, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT)) ELSE 0 END AS val FROM (SELECT p_type AS grp, count(*) AS n FROM part GROUP BY 1))")
def split_counts(spark, folder):
    stems = D.table(spark, folder, "part").select(F.concat("p_type", F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("stem"))
    groups = stems.groupBy(datasets.asset_group(F.col("stem")).alias("group")).agg(F.count("*").alias("n"))
    return datasets.split_counts(groups, 0.15)


@query("class_weights", "L9", "SELECT lang, n, (SELECT count(*) FROM documents) / (k * n) AS weight FROM (SELECT lang, count(*) AS n, count(*) OVER () AS k FROM documents GROUP BY 1)")
def class_weights(spark, folder):
    return datasets.class_weights(D.table(spark, folder, "documents"), "lang")


_REPORT = {"per": """SELECT label, support, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r, hit FROM (
    SELECT label, CAST(sum(s) AS BIGINT) AS support, CAST(sum(g) AS BIGINT) AS guessed, CAST(sum(h) AS BIGINT) AS hit FROM (
      SELECT CAST(quality AS VARCHAR) AS label, 1 AS s, 0 AS g, CAST(quality = pred AS INTEGER) AS h FROM obs UNION ALL SELECT CAST(pred AS VARCHAR), 0, 1, 0 FROM obs) GROUP BY 1)""",
    "obs": "SELECT quality, CASE WHEN doc_id % 4 = 0 THEN 2 WHEN toxic = 1 THEN 0 ELSE quality END AS pred FROM labels",
    "scored": "SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM per"}


@query("classification_report", "L10", with_views(
    " UNION ALL ".join([
        "SELECT label, round(CAST(p AS DECIMAL(20,9)), 4)::DOUBLE AS precision, round(CAST(r AS DECIMAL(20,9)), 4)::DOUBLE AS recall, round(CAST(f AS DECIMAL(20,9)), 4)::DOUBLE AS f1, support FROM scored",
        "SELECT 'accuracy', round(CAST(sum(hit) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(sum(hit) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(sum(hit) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, CAST(sum(support) AS BIGINT) FROM scored",
        "SELECT 'macro avg', round(CAST(avg(p) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(avg(r) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(avg(f) AS DECIMAL(20,9)), 4)::DOUBLE, CAST(sum(support) AS BIGINT) FROM scored",
        "SELECT 'weighted avg', round(CAST(sum(p * support) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(sum(r * support) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, round(CAST(sum(f * support) / sum(support) AS DECIMAL(20,9)), 4)::DOUBLE, CAST(sum(support) AS BIGINT) FROM scored"]),
    extra={"obs": _REPORT["obs"], "per": _REPORT["per"], "scored": _REPORT["scored"]}))
def classification_report(spark, folder):
    guess = F.when(F.col("doc_id") % 4 == 0, 2).when(F.col("toxic") == 1, 0).otherwise(F.col("quality"))
    return datasets.classification_report(D.table(spark, folder, "labels").withColumn("pred", guess), "quality", "pred")


@query("dataset_faults", "L11", "SELECT s.source AS split, c.class, coalesce(n, 0) AS n FROM (SELECT DISTINCT source FROM documents) s, (SELECT unnest(['de', 'en', 'xx']) AS class) c LEFT JOIN (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2) d ON d.source = s.source AND d.lang = c.class WHERE coalesce(n, 0) < 15")
def dataset_faults(spark, folder):
    rows = D.table(spark, folder, "documents").select(F.col("source").alias("split"), F.col("lang").alias("class"))
    return datasets.structure_faults(rows, ["de", "en", "xx"], minimum=15)
