"""Training-data operators: deduplication, scoring, extraction, formatting, tokenising.

Nothing outside this subpackage imports it.
"""
