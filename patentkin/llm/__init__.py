"""Operators for building training corpora, their queries and SQL checks."""
