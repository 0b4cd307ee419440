"""Operators for preparing training corpora: deduplication, filtering, scoring and packing."""
