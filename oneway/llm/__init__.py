"""Operators for preparing training corpora: deduplication, filtering, scoring, search, mixing, sharding.

Nothing else in the library imports this subpackage.
"""
