"""Operators that prepare text, pages and embeddings for training language models.

Nothing else in the library imports this subpackage.
"""
