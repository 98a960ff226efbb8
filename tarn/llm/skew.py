"""Joins of many rows with a table of one row for each key, where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are hot, whatever the table; fewer rows than FLOOR never are.
HOT, FLOOR = 10_000, 256


def hot_above(rows: int) -> int:
    """Of so many rows, keys with more than this are at most HOT: they may be broadcast."""
    return max(FLOOR, rows // HOT)


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], n: str, limit: int, own: bool = False) -> DataFrame:
    """rows with table's columns, by keys. table[n] counts the rows of a key; limit is hot_above() of all rows.

    Rows of hot keys meet them by broadcast where they lie, so only keys of at most limit rows are dealt out by key. own:
    rows have the count themselves, and need not all have a key in table.
    """
    hot, cold = table.where(F.col(n) > limit), table.where(F.col(n) <= limit)
    if own:
        return rows.where(F.col(n) > limit).join(F.broadcast(hot.drop(n)), keys).unionByName(rows.where(F.col(n) <= limit).join(cold.drop(n), keys))
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return rows.join(F.broadcast(hot), keys).unionByName(rest.join(cold, keys))


def least_hashed(df: DataFrame, hashes: list[str], n: int, total: int) -> DataFrame:
    """The n rows of least hashes, of total rows: all but about 2 * n are left out where they lie, by the first hash, so the
    one task that orders the rest gets no more than these, however many partitions there are."""
    share = 2 * n / max(total, 1)
    if share < 1:
        df = df.where(F.col(hashes[0]) < int(share * 2**64) - 2**63)
    return df.orderBy(*hashes).limit(n)
