"""Operators for large text corpora: sharding, mixing, redaction, search, deduplication,
quality, URL filters and packing. Nothing else in the library imports this package."""
