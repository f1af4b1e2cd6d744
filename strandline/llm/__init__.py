"""Operators for training-data pipelines: splitting, near-duplicates, heavy hitters, tokenizing, leakage, text quality.

Nothing outside this package imports it.
"""
