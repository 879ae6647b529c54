"""Operators for training data: deduplication, filtering, extraction and tokenisation of texts.

Nothing else in the package imports this one.
"""
