"""Structured Streaming: ingest of new images or vectors, and centroids kept as sums and counts."""
