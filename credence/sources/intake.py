"""Reading tables, uploads, regions and labelled files; intake rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credence import reference_values as V
from credence.functions.arrays import one_of
from credence.functions.text import canonical_city


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A Parquet table; an explicit schema avoids touching the files to plan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """Uploaded files as rows with their bytes."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("filename"), "content", "length", "modificationTime")


def extension_of(filename: Column) -> Column:
    return F.lower(F.regexp_extract(filename, r"\.([^./]+)$", 1))


def detected_mime(content: Column) -> Column:
    """Type by leading bytes. Only the first eight bytes are looked at."""
    head = F.hex(F.substring(content, 1, 8))
    ladder = None
    for mime, magic in V.MAGIC_BYTES.items():
        hit = head.startswith(magic)
        ladder = F.when(hit, mime) if ladder is None else ladder.when(hit, mime)
    return ladder


def reject_reason(filename: Column, declared: Column, content: Column, length: Column, max_mb: int = V.MAX_FILE_MB) -> Column:
    """First violated intake rule, NULL when the upload is accepted."""
    expected = one_of(extension_of(filename), V.ACCEPTED_MIME)
    return (F.when(expected.isNull(), "unsupported_type")
            .when(~declared.eqNullSafe(expected), "mime_mismatch")
            .when(F.coalesce(length, F.lit(0)) == 0, "empty_file")
            .when(length > max_mb * 1024 * 1024, "too_large")
            .when(~detected_mime(content).eqNullSafe(expected), "content_mismatch"))


def first_pages(pages: DataFrame, limit: int = V.MAX_PAGES) -> DataFrame:
    """The first pages of each document (page_index starts at 1)."""
    return pages.where(F.col("page_index") <= limit)


def batch_faults(files: DataFrame, max_batch_mb: int = V.MAX_BATCH_MB, accepted: str = "pdf,png,jpg,jpeg") -> DataFrame:
    """Per submission: total size and files of a format not accepted."""
    allowed = F.split(F.lit(accepted), ",")
    wrong = ~F.array_contains(allowed, F.lower(F.col("extension")))
    totals = files.groupBy("submission_id").agg(F.sum("file_size_bytes").alias("total_bytes"), F.count_if(wrong).alias("wrong_formats"))
    return totals.withColumn("too_large", F.col("total_bytes") > max_batch_mb * 1024 * 1024)


def parse_reference_map(raw: Column) -> Column:
    """JSON object city -> vector as entries with canonical keys; of keys that
    become equal the last one wins. A broken object gives NULL."""
    entries = F.map_entries(F.from_json(raw, "map<string,array<double>>"))
    keyed = F.transform(entries, lambda e: F.struct(F.coalesce(canonical_city(e["key"]), F.lit("")).alias("city"), e["value"].alias("vector")))
    size = F.size(keyed)
    return F.filter(keyed, lambda e, i: ~F.exists(F.slice(keyed, i + 2, size), lambda later: later["city"] == e["city"]))


ROI_BOX = "struct<x:double,y:double,w:double,h:double>"


def roi_table(configs: DataFrame, nested: str = "business_permit") -> DataFrame:
    """Region configuration in long form from JSON text (column ``raw``):
    template -> field -> box, and template -> city -> field -> box for permits."""
    top = configs.select(F.explode(F.from_json("raw", "map<string,string>")).alias("template", "body"))
    flat = top.where(F.col("template") != nested).select("template", F.lit("").alias("city"), F.explode(F.from_json("body", f"map<string,{ROI_BOX}>")).alias("field_key", "b"))
    cities = top.where(F.col("template") == nested).select("template", F.explode(F.from_json("body", "map<string,string>")).alias("city", "inner"))
    deep = cities.select("template", "city", F.explode(F.from_json("inner", f"map<string,{ROI_BOX}>")).alias("field_key", "b"))
    return flat.unionByName(deep).select("template", "city", "field_key", "b.*")


def read_roi_config(spark: SparkSession, path: str) -> DataFrame:
    """A region configuration file (one JSON document)."""
    return roi_table(spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw"))


def labelled_file(path: Column) -> dict[str, Column]:
    """Class (directory), stem, group stem and variant of a data-set image path."""
    stem = F.regexp_extract(path, r"([^/]+)\.[A-Za-z]+$", 1)
    return {
        "class": F.regexp_extract(path, r"([^/]+)/[^/]+$", 1), "stem": stem,
        "group_stem": F.regexp_replace(stem, r"_(clean|scan)$", ""),
        "variant": F.nullif(F.regexp_extract(stem, r"_(clean|scan)$", 1), F.lit(""))}


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """Labelled images under class directories, without their bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.where(F.lower("path").rlike(r"\.(png|jpg|jpeg)$")).withColumns(labelled_file(F.col("path")))


def read_written(spark: SparkSession, path: str) -> DataFrame:
    """Files as ``sinks.write_files`` leaves them: folder, name, content, length and
    modificationTime. Columns that are not asked for are not read; without ``content``
    the scan only lists."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "name=*").load(path)
    part = lambda key: F.url_decode(F.regexp_extract("path", rf"/{key}=([^/]*)", 1)).alias(key)
    return files.select(part("folder"), part("name"), "content", "length", "modificationTime")
