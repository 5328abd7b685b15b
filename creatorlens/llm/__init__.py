"""Operators for preparing training data: search, filtering, dedup, archives, packing."""
