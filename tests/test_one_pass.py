"""Work is dealt evenly, and a table is shuffled once where one shuffle does."""

import pytest

from credence.plans import catalog, layout_queries

FOLDER = "/root/testdata/sf0.001"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_forms_are_dealt_before_their_words_are_laid_out(spark):
    form = layout_queries.form_words(spark, FOLDER)
    assert form.rdd.getNumPartitions() >= 32
    assert _plan(catalog.QUERIES["caption_boxes"](spark, FOLDER)).count("Exchange") == 1


def test_result_columns_shuffle_line_items_only(spark):
    plan = _plan(catalog.QUERIES["result_columns"](spark, FOLDER))
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1 and "hashpartitioning(l_orderkey" in plan


@pytest.mark.parametrize(("name", "scans"), [
    ("pending_queue", 1), ("pending_queue_search", 1), ("archived_reports", 1), ("component_breakdown", 1), ("risk_log_search", 2)])
def test_documents_are_read_once(spark, name, scans):
    plan = _plan(catalog.QUERIES[name](spark, FOLDER))
    assert plan.count("l_shipdate") and plan.count("lineitem.parquet") == scans
