"""Encoding, indexing, search, statistics and incremental loading."""
