"""Training-data operators: deduplication, filtering, mixing, encoding and scoring of text corpora."""
