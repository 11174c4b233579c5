"""Tender matching on Spark: ingest, retrieval, matching, digests and evaluation as DataFrame jobs."""
