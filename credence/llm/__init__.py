"""Operators for large text corpora: joins, filters, models, searches and encoding."""
