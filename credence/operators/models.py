"""Model files: inventory sync and manifest reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.functions.arrays import compact, flag_if


def sync(registry: DataFrame, inventory: DataFrame, with_hash: bool = False) -> DataFrame:
    """Registry rows after a look at the files: a lost file turns active and
    standby models missing, a found one turns missing models standby;
    deprecated models keep their state."""
    present = inventory.select("storage_path", F.lit(True).alias("_found"), F.col("file_size_bytes").alias("_size"),
                               F.col("modified_at").alias("_modified"), F.col("checksum_sha256").alias("_sum"))
    joined = registry.join(present, "storage_path", "left")
    found = F.coalesce("_found", F.lit(False))
    status = (F.when(~found & ~F.col("status").isin("missing", "deprecated"), "missing")
              .when(found & (F.col("status") == "missing"), "standby").otherwise(F.col("status")))
    checksum = F.coalesce("_sum", "checksum_sha256") if with_hash else F.col("checksum_sha256")
    return joined.select("model_id", "name", "purpose", "storage_path", found.alias("found"), status.alias("status"),
                         F.col("_size").alias("file_size_bytes"), F.col("_modified").alias("last_trained_at"),
                         checksum.alias("checksum_sha256"))


def sync_counts(synced: DataFrame, *more: Column) -> DataFrame:
    """Files looked for, found and missing, and what else the caller asks for."""
    return synced.agg(F.count("*").alias("scanned"), F.count_if("found").alias("found"),
                      F.count_if(~F.col("found")).alias("missing"), *more)


def file_inventory(files: DataFrame) -> DataFrame:
    """A ``binaryFile`` listing with size and SHA-256."""
    return files.select(F.col("path").alias("storage_path"), F.col("length").alias("file_size_bytes"),
                        F.col("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("checksum_sha256"))


def manifest_report(statuses: DataFrame, manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Per-model compatibility and readiness errors.

    statuses: name, storage_path, loaded, required; manifest: name, version,
    sha256; inventory: storage_path, checksum_sha256."""
    entries = manifest.select("name", "version", "sha256", F.lit(True).alias("_entry"))
    files = inventory.select("storage_path", F.col("checksum_sha256").alias("_sum"), F.lit(True).alias("_file"))
    joined = statuses.join(entries, "name", "left").join(files, "storage_path", "left")
    declared, exists = F.col("_entry").isNotNull(), F.col("_file").isNotNull()
    good = F.coalesce(exists & (F.length("sha256") == 64) & (F.lower("sha256") == F.col("_sum")), F.lit(False))
    state = (F.when(~declared, "entry_missing").when(~exists, "artifact_missing")
             .when(good, "compatible").otherwise("checksum_mismatch"))
    required = F.col("required")
    errors = compact(
        flag_if(required & ~F.col("loaded"), F.concat("name", F.lit(":model_not_loaded"))),
        flag_if(required & ~declared, F.concat("name", F.lit(":manifest_entry_missing"))),
        flag_if(required & declared & ~good, F.concat("name", F.lit(":artifact_incompatible"))))
    return joined.select("name", "version", good.alias("compatible"), state.alias("manifest_status"), errors.alias("errors"))
