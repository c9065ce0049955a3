"""Operators of a training-data pipeline: scans, near-duplicates, tokens, search, mixing, chat."""
