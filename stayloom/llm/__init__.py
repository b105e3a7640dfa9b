"""Operators of a training-data pipeline: mixing, filters, near-duplicates, search and token work."""
