"""Session helpers shared by the entry module, the tests and the benchmark."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "credence", master: str | None = None,
                  shuffle_partitions: int | None = None, shared: str | None = None) -> SparkSession:
    """A session with the settings the operators assume; on a cluster the
    submitted configuration wins for master, memory and partition counts. ``shared`` is
    the checkpoint folder of a test or a bench run, whose caller removes it."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, which the cluster names in
    ``spark.checkpoint.dir``. Only a session that runs in one process may do
    without: it gets a temporary folder. On a cluster that would be the driver's
    own disk, so there it is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not configured and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="spark-"))
    return configured or context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by writing to the shared checkpoint folder, so a lost
    executor never forces a different recomputation of the rows."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt evenly before costly work on each: a small table is often one file of
    one row group, which Spark reads, and so works on, in one task."""
    session = df.sparkSession
    return df.repartition(max(4 * session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions"))), *keys)


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """``durable`` as a Parquet folder by the values of ``parts``: whoever reads it
    reads the columns and parts asked for only, and plans over a plain scan."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
