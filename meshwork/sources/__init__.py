"""Readers and writers: text edge and adjacency lists, result vectors, matrix blocks."""
