"""Bounded samples of labelled documents, for the classifiers that are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from credence.llm.common import fold

#: Labelled rows a classifier learns from, at most.
MOST_ROWS = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, most: int = MOST_ROWS) -> DataFrame:
    """doc_id, text, label (0 or 1) and part (0 to 4) of at most ``most`` labelled
    ids, chosen by a hash of the id among those where ``learn`` holds.

    Null ids and labels are left out; an id labelled twice has its larger label.
    The ids come to the driver (``most`` bounds them) and go out with the plan, so
    no text is shuffled. ``part`` cuts the sample for out-of-fold predictions."""
    rows = (labels.select("doc_id", F.col(label).cast("int").alias("label"))
            .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & learn)
            .groupBy("doc_id").agg(F.max("label").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect())
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r.doc_id, r.label) for r in rows], "doc_id long, label int")
    parts = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.lit(5)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label", parts.alias("part"))


def held_out(key: Column) -> Column:
    """Rows that are never learned from: crc32 of the id modulo 5 is 0."""
    return F.coalesce(fold(key, 5) == 0, F.lit(False))
