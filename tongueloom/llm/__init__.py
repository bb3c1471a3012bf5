"""Operators of a training-data pipeline: filters, near-duplicate search, scoring, tokenising and pseudonyms.

Nothing outside this package imports it; it may use the general helpers of the library.
"""
