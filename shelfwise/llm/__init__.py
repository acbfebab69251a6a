"""Operators of a training-data pipeline: quality, near copies, personal data, tokens, mixing, packing, search."""
