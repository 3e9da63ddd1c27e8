"""Incremental loading: what is pending, and old and new together."""

from __future__ import annotations

from pyspark.sql import DataFrame


def pending(catalogue: DataFrame, stored: DataFrame, key: str = "image_id", force: bool = False) -> DataFrame:
    """Rows of the catalogue whose key is not stored; all with force. Keys only are compared, before any content is read."""
    return catalogue if force else catalogue.join(stored.select(key), key, "left_anti")


def appended(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows; disjoint if new comes from ``pending``."""
    return stored.unionByName(new)


def first_rows(catalogue: DataFrame, n: int, *order: str) -> DataFrame:
    """A test run's rows: the first n by a stated order."""
    return catalogue.orderBy(*order).limit(n)


def first_pending(catalogue: DataFrame, stored: DataFrame, n: int, *order: str, key: str = "image_id") -> DataFrame:
    """A test run's rows: the first n that are pending, or the first n of all if none is."""
    todo = pending(catalogue, stored, key)
    return first_rows(catalogue if todo.isEmpty() else todo, n, *order)
