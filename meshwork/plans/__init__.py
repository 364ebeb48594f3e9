"""Iterated matrix-vector programs and their plans."""
