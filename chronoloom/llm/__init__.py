"""Operators for preparing training text: mixing, deduplication, packing, filters, scoring, search, sharding."""
