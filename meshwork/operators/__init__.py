"""Operators on graphs: transforms, degrees, matrix blocks."""
