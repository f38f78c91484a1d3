"""Operators for training-data pipelines: filters, scans, near-duplicates, formats and fingerprints."""
