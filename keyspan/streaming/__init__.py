"""Incremental consumption of new files."""
