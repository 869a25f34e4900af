"""Incremental enrichment."""
