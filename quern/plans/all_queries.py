"""Importing this registers every query."""

from quern.plans import corpus_queries, evidence_queries, model_queries, source_queries, text_queries  # noqa: F401
