"""Incremental ingest of landing folders."""
