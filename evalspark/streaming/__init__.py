"""Incremental scoring of prediction files as they arrive."""
