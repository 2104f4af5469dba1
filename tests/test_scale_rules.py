"""No caps, no folder of one machine, and plans that reduce before they shuffle."""

import pytest
from pyspark.sql import functions as F

from credence import session
from credence.operators import audit, notices
from credence.plans import catalog

FOLDER = "/root/testdata/sf0.001"


def test_export_and_notices_have_no_cap(spark):
    logs = spark.range(60_000).select(F.col("id").alias("log_id"), (F.col("id") % 7).alias("user_id"), F.timestamp_seconds("id").alias("created_at"), F.lit("a").alias("action"),
                                      F.lit("B\\C").alias("entity_type"), F.col("id").alias("entity_id"), F.lit("ip").alias("ip_address"), F.lit(None).cast("string").alias("details"))
    users = spark.range(12_000).select(F.col("id").alias("user_id"), F.lit("n").alias("name"), F.lit("e").alias("email"), F.lit("admin").alias("role"))
    rows = audit.export_rows(logs, users)
    assert rows.count() == 60_000 and audit.export_rows(logs, users, limit=5).count() == 5
    assert audit.acting_users(logs, users).count() == 7
    submissions = spark.sql("SELECT 1L AS submission_id, 2L AS vendor_id, 90.0D AS composite_risk_score, 'high' AS risk_level, array('x') AS flags")
    vendors = spark.sql("SELECT 2L AS vendor_id, 3L AS user_id, 'Firm' AS company_name")
    assert notices.processed(submissions, vendors, users).count() == 12_001


class _Session:
    def __init__(self, master, folder=None):
        self.conf = self
        self.sparkContext = self
        self.master, self._folder = master, folder

    def get(self, key, default):
        return self._folder or default

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, folder):
        self.set_to = folder


def test_clusters_need_a_shared_folder():
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(_Session("spark://host:7077"))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(_Session("local-cluster[2,1,1024]"))
    assert session.ensure_checkpoint_dir(_Session("yarn", "hdfs:///x")) == "hdfs:///x"


@pytest.mark.parametrize("name", ["latest_attempts", "document_list", "submission_rollup", "pending_queue", "risk_log_search"])
def test_views_are_hash_aggregated(spark, name):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan
