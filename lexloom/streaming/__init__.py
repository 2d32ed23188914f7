"""Incremental scoring of arriving dumps."""
