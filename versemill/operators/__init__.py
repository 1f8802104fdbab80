"""Relational operators over verse-grained tables."""
