"""Operators of a training-data pipeline: archives, deduplication, scoring, classification, search, tokens, mixing."""
