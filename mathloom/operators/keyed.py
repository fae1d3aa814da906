"""Keyed tables: the last row of a key, what is still to do, updates and deletions, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_by_key(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key. ``max_by`` combines before the shuffle, so a key with a third of all rows is no burden."""
    row = F.struct(*df.columns)
    at = F.struct(*(F.col(c) for c in order))  # never null itself, so a key whose order values are null keeps its row
    return df.groupBy(F.col(key).alias("_key")).agg(F.max_by(row, at).alias("_row")).select("_row.*")


def todo(rows: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key is not done yet."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str, *order: str) -> DataFrame:
    """Old rows, replaced or added to by the last new row of their key."""
    latest = last_by_key(new, key, *order)
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def delete(rows: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")
