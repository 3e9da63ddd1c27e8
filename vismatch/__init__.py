"""vismatch: visual-similarity analytics over image catalogues, as Spark DataFrame operations."""
