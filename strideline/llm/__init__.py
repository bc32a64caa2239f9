"""Operators for preparing training text: deduplication, filtering, tokenising, packing, search."""
