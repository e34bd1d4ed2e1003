"""Readers and table mappings."""
