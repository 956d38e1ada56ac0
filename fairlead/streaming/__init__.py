"""Incremental ingest of report files."""
