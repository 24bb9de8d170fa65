"""Operators for preparing training text: deduplication, filtering, counting, mixing, packing."""
