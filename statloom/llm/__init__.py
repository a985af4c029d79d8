"""Operators for preparing training text: mixing, scoring, filtering, deduplication, packing, search."""
