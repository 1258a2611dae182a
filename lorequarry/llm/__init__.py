"""Operators for preparing training text: counting, encoding, sharding, deduplication, filtering.

Nothing outside this subpackage imports it.
"""
