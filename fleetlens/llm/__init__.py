"""Operators for preparing training text: search, duplicates, filters, tokens, packing, sharding."""
