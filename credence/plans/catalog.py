"""Imports every query module so that the registry is complete."""

from credence.plans import evidence_queries, file_queries, layout_queries, operations_queries, page_queries, review_queries, stream_queries, text_queries, upkeep_queries  # noqa: F401
from credence.plans.registry import COVERS, QUERIES, STATEMENTS  # noqa: F401
