"""Helpers shared by the corpus operators: tables, words, folds and durable steps."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from credence.session import ensure_checkpoint_dir

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LIBC = ctypes.CDLL(None)
#: A-Z become a-z; every other byte stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Words of a text: runs of anything but ASCII white space. ``bytes.split()``
#: without an argument cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words(data: bytes) -> list[bytes]:
    """The lower-cased words of a UTF-8 text."""
    return data.translate(LOWER).split()


def fold(key: Column, count: int) -> Column:
    """``crc32`` of an id written as text, modulo ``count``; null ids give null."""
    return F.crc32(key.cast("string").cast("binary")) % count


def durable(df: DataFrame) -> DataFrame:
    """Write the rows to the cluster's shared folder and go on from there, so that
    a lost executor costs one task and never a different recomputation.

    The folder is the session's ``spark.checkpoint.dir``. Where that is unset, a
    session of one process gets a temporary folder, a cluster an error. Shuffle
    files go with the write: later steps read the table."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes, nulls kept."""
    column = batch.column(batch.schema.get_field_index(name))
    wide = pa.types.is_large_string(column.type)
    return column.cast(pa.large_binary() if wide else pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` and, but for single rows that
    are larger, ``size`` bytes: bounds what one step holds when texts are long."""
    for batch in batches:
        start = 0
        while start < batch.num_rows:
            n = min(rows, batch.num_rows - start)
            while n > 1 and batch.slice(start, n).nbytes > size:
                n //= 2
            yield batch.slice(start, n)
            start += n


def give_back() -> None:
    """Return freed memory to the system. Python workers live on after a task, and
    several share an executor's memory with its JVM."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def mapped(df: DataFrame, run: Batches, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end."""
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()
    return df.mapInArrow(tidy, schema)


def per_text(docs: DataFrame, schema: str, names: list[str],
             make: Callable[[], Callable[[list[bytes | None]], list[list]]]) -> DataFrame:
    """Columns ``names`` computed from whole texts, next to ``doc_id``.

    ``make`` is called once per task and returns a function from a list of texts
    to one list per output column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, out = make(), None
        for batch in slices(batches):
            columns = step(byte_column(batch, "text"))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            out = pa.RecordBatch.from_arrays([ids, *(pa.array(c) for c in columns)], ["doc_id", *names])
            yield out
    return mapped(docs.select("doc_id", "text"), run, schema)


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[list[bytes | None]], np.ndarray]]) -> DataFrame:
    """The rows of ``docs``, every column as it is, whose text passes.

    ``make`` is called once per task and returns a function from a list of texts
    to a boolean array. Nothing is shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in slices(batches):
            yield batch.filter(pa.array(np.asarray(step(byte_column(batch, "text")), dtype=bool)))
    return mapped(docs, run, docs.schema)
