"""Incremental ingest of run reports and the summaries kept from it."""
