"""Joins of a large table with a lookup table."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join with a table that has at most one row per key.

    Adaptive execution decides by measured sizes: a small lookup is broadcast, and a key with a third of
    all rows is split over many tasks (skew join), each with that key's one lookup row.
    """
    return left.join(right, key, "left")
