"""A ledger of records that must not repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.operators.ordering import number_rows


def unused_records(candidates: DataFrame, ledger: DataFrame, business_key: str, wanted: int | None = None) -> DataFrame:
    """Candidates whose business key and content hash are both new, each once,
    numbered after the ledger's last index.

    Over-generate and pass all candidates; ``wanted`` cuts the result."""
    others = [c for c in candidates.columns if c not in ("content_hash",)]
    by_hash = candidates.groupBy("content_hash").agg(F.min(F.struct("record_id", *[c for c in others if c != "record_id"])).alias("r")).select("content_hash", "r.*")
    rest = [c for c in by_hash.columns if c not in (business_key, "record_id")]
    by_key = by_hash.groupBy(business_key).agg(F.min(F.struct("record_id", *rest)).alias("r")).select(business_key, "r.*")
    fresh = by_key.join(ledger.select("content_hash"), "content_hash", "left_anti").join(ledger.select(business_key), business_key, "left_anti")
    numbered = number_rows(fresh, [F.col("record_id")], "_n")
    start = ledger.agg(F.coalesce(F.max("index"), F.lit(0))).scalar()
    rows = numbered.withColumn("index", F.col("_n") + start)
    return (rows if wanted is None else rows.where(F.col("_n") <= wanted)).drop("_n")

