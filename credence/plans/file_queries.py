"""Registered queries on real files: what a table gives is written, scanned and read
back."""

from __future__ import annotations

from pyspark.sql import functions as F

from credence.functions.dates import stamp
from credence.operators import audit, models, mutate
from credence.plans import domain as D
from credence.plans.domain_sql import with_views
from credence.plans.operations_queries import decided
from credence.plans.registry import STATEMENTS, query
from credence.session import stored
from credence.sources import intake, sinks
from credence.streaming.jobs import work_folder

_SENT = {"sent": """SELECT s_suppkey AS k, s_nationkey AS folder, 'scan-' || s_suppkey || ['.pdf', '.PDF', '.png', '.txt', '.pdf'][s_suppkey % 5 + 1] AS name,
    ['application/pdf', 'application/pdf', 'image/png', 'text/plain', 'image/png'][s_suppkey % 5 + 1] AS declared,
    CASE WHEN s_suppkey % 7 = 0 THEN 'GIF89a ' ELSE '%PDF-1.7 ' END || s_name || ' ' || s_suppkey AS body FROM supplier"""}


def _sent(spark, folder):
    """One upload per supplier, in a folder per nation."""
    k = F.col("s_suppkey")
    choose = lambda *values: F.get(F.array(*[F.lit(v) for v in values]), (k % 5).cast("int"))
    return D.table(spark, folder, "supplier").select(
        k.alias("k"), F.col("s_nationkey").alias("folder"), F.concat(F.lit("scan-"), k, choose(".pdf", ".PDF", ".png", ".txt", ".pdf")).alias("name"),
        choose("application/pdf", "application/pdf", "image/png", "text/plain", "image/png").alias("declared"),
        F.concat(F.when(k % 7 == 0, "GIF89a ").otherwise("%PDF-1.7 "), "s_name", F.lit(" "), k).alias("body"))


@query("stored_uploads", "A2", with_views(
    """SELECT k, name, strlen(body) + 1 AS length, sha256(body || chr(10)) AS checksum, CASE k % 5 WHEN 3 THEN 'unsupported_type' WHEN 4 THEN 'mime_mismatch' WHEN 2 THEN 'content_mismatch'
       ELSE CASE WHEN k % 7 = 0 THEN 'content_mismatch' END END AS reason FROM sent""", extra=_SENT))
def stored_uploads(spark, folder):
    """Uploads written as files and judged from a scan of their bytes."""
    root = work_folder(spark, "uploads")
    sent = _sent(spark, folder)
    sinks.write_files(sent, root)
    files = intake.read_written(spark, root)
    seen = files.select("name", "length", F.sha2("content", 256).alias("checksum"), F.substring("content", 1, 8).alias("head"))
    reason = intake.reject_reason(F.col("name"), F.col("declared"), F.col("head"), F.col("length"))
    return sent.select("k", "name", "declared").join(seen, "name").select("k", "name", "length", "checksum", reason.alias("reason"))


@query("labelled_folders", "A10", with_views(
    """SELECT CAST(folder AS VARCHAR) AS class, count(*) AS files, count(*) FILTER (lower(name) LIKE '%.png') AS images, CAST(sum(strlen(body) + 1) AS BIGINT) AS bytes FROM sent GROUP BY 1""", extra=_SENT))
def labelled_folders(spark, folder):
    """Files per class folder, from a listing: no byte of them is read."""
    root = work_folder(spark, "labelled")
    sinks.write_files(_sent(spark, folder), root)
    files = intake.read_written(spark, root).withColumnRenamed("folder", "class")
    return files.groupBy("class").agg(F.count("*").alias("files"), F.count_if(F.lower("name").endswith(".png")).alias("images"), F.sum("length").alias("bytes"))


_MODELS = {"registry_": """SELECT s_suppkey AS model_id, 'model ' || s_suppkey AS name, 'p' || (s_nationkey % 4) AS purpose, s_nationkey || '/m-' || s_suppkey AS storage_path,
      ['active', 'standby', 'missing', 'deprecated'][s_suppkey % 4 + 1] AS status, s_name AS body, s_suppkey % 3 <> 0 AS stored FROM supplier"""}


@query("stored_models", "H14", with_views(
    """SELECT model_id, name, purpose, stored AS found, CASE WHEN NOT stored AND status NOT IN ('missing', 'deprecated') THEN 'missing' WHEN stored AND status = 'missing' THEN 'standby' ELSE status END AS status,
       CASE WHEN stored THEN strlen(body) + 1 END AS file_size_bytes, CASE WHEN stored THEN sha256(body || chr(10)) END AS checksum_sha256 FROM registry_""", extra=_MODELS))
def stored_models(spark, folder):
    """A registry brought in line with the model files that are there; their hashes
    are taken in the scan."""
    root = work_folder(spark, "models")
    k = F.col("s_suppkey")
    states = F.array(*[F.lit(s) for s in ("active", "standby", "missing", "deprecated")])
    known = D.table(spark, folder, "supplier").select(
        k.alias("model_id"), F.concat(F.lit("model "), k).alias("name"), F.concat(F.lit("p"), F.col("s_nationkey") % 4).alias("purpose"),
        F.concat("s_nationkey", F.lit("/m-"), k).alias("storage_path"), F.get(states, (k % 4).cast("int")).alias("status"), F.lit(None).cast("string").alias("checksum_sha256"),
        F.col("s_nationkey").alias("folder"), F.col("s_name").alias("body"))
    sinks.write_files(known.where(F.col("model_id") % 3 != 0).withColumn("name", F.concat(F.lit("m-"), "model_id")), root)
    files = intake.read_written(spark, root).select(F.concat_ws("/", "folder", "name").alias("path"), "length", "modificationTime", "content")
    rows = models.sync(known.drop("folder", "body"), models.file_inventory(files), with_hash=True)
    return rows.select("model_id", "name", "purpose", "found", "status", "file_size_bytes", "checksum_sha256")


@query("audit_export_file", "A7", STATEMENTS["audit_export"])
def audit_export_file(spark, folder):
    """The audit export written as CSV and read back."""
    path = work_folder(spark, "export")
    rows = audit.export_rows(audit.filtered(D.audit_logs(spark, folder)), D.users(spark, folder))
    sinks.export_csv(rows, path)
    plain = ", ".join(f"`{c}` string" for c in rows.columns)
    read = spark.read.schema(plain).option("header", "true").option("escape", '"').option("multiLine", "true").option("nullValue", "\x00").csv(path)
    return read.select(*[F.nullif(c, F.lit("")).cast(t).alias(c) if t != "string" else F.col(c) for c, t in rows.dtypes])


@query("decision_log", "A8 H5", STATEMENTS["decision_events"])
def decision_log(spark, folder):
    """Decisions appended to the log in two batches, by year, and read back."""
    path = work_folder(spark, "decisions")
    events = mutate.decision_events(decided(spark, folder)).select("user_id", "action", "entity_id", "details.vendor_id", "details.risk_level", "created_at")
    rows = stored(events)  # read once a batch
    for rest in (0, 1):
        sinks.append_log(rows.where(F.col("entity_id") % 2 == rest), path, unit="year")
    return spark.read.parquet(path).select("user_id", "action", "entity_id", "vendor_id", "risk_level", stamp(F.col("created_at")).alias("created_at"))
