"""Operators for large text corpora: quality, language, sharding, deduplication, mixing, encoding, scoring, search."""
