"""Readers, writers and the declared schemas of the clinical tables."""
