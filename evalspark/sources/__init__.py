"""Readers, writers and table preparation."""
