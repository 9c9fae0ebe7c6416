"""Incremental maintenance from a change log."""
