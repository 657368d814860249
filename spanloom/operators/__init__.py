"""Operators over documents that carry arrays of half-open character spans."""
