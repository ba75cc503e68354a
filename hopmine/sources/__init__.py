"""Readers and writers of graph tables, and the graph that is derived from the star-schema tables."""
