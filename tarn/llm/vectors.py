"""Rows of vectors, with equal ones brought together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALT = 64


def usable(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, v): ids that are not null, with vectors of finite components that are not all zero."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null and v is not null")
    return rows.where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))


def smallest_ids(rows: DataFrame, keys: list[str], n: int, order: str = "vec_id") -> DataFrame:
    """keys and the n smallest ids of each: first within salts, so one key may hold any share of the rows."""
    salted = Window.partitionBy(*keys, "_salt").orderBy(order)
    whole = Window.partitionBy(*keys).orderBy(order)
    some = rows.select(*keys, order, F.pmod(F.xxhash64(order), F.lit(SALT)).alias("_salt")).distinct()
    some = some.withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= n)
    some = some.withColumn("_n", F.row_number().over(whole)).where(F.col("_n") <= n)
    return some.groupBy(*keys).agg(F.array_sort(F.collect_list(order)).alias("ids"))


def best(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key, numbered by rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def best_entries(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The entries that hold the n nearest ids of each key, whatever ids their rows share.

    rows has first, the smallest id of an entry, and n, how many ids it has. In order of nearness and first, entries
    are taken until n different firsts are held: what comes later is no nearer and has larger ids only. An entry of one
    row whose id has been there already adds nothing.
    """
    nearer, before = Window.partitionBy(*keys, "first").orderBy(*order), Window.partitionBy(*keys).orderBy(*order)
    out = rows.withColumn("_new", (F.row_number().over(nearer) == 1).cast("int")).where("_new = 1 or n > 1")
    out = out.withColumn("_held", F.coalesce(F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.where(F.col("_held") < n).drop("_new", "_held")
