"""Operators for preparing training data: secrets, near duplicates, substring and
benchmark overlap, quality, tokenisation, vector search and URL filters.

Nothing else in the library imports this subpackage.
"""
