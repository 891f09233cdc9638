"""Incremental and streaming ingest."""
