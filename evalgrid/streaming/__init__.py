"""Incremental ingestion of result files."""
