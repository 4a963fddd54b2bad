"""Training-data operators: deduplication, scoring, sharding, tokenising and archive formats.

Nothing outside this subpackage imports it.
"""
