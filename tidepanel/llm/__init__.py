"""Operators for preparing training data: quality rules, duplicates, archives, tokens, media and packing."""
