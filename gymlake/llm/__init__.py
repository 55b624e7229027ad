"""Operators of a training-data pipeline over the ``documents`` and ``embeddings`` tables.

Self-contained: nothing else in the library imports this package, so it can be
removed as a whole.
"""
