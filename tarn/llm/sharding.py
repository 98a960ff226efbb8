"""Longest-processing-time sharding of groups that stay together.

The schedule needs group sizes only, and groups of one size are interchangeable. So the driver reads the histogram of
group sizes, largest first and a partition at a time, never the groups: at most sqrt(2 * total bytes) rows, since distinct
sizes add up to no more than the total. It runs the heap over the histogram and writes down, PLANNED sizes at a time, how
many groups of each size every shard takes; it holds no more than that. Groups find their shard by their rank among the
groups of their size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarn.llm.skew import hot_above, join_spread
from tarn.sources import scratch, scratch_dir

OVERHEAD = 16
BUCKETS = 256
#: Sizes that the driver plans before it writes them down.
PLANNED = 50_000
PLAN = "group_size long, starts array<long>, owners array<int>"


def schedule(histogram: Iterable[tuple[int, int]], shards: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """Largest sizes first, each group to the least-loaded shard (ties: the smaller shard).

    histogram: (size of a group, number of such groups), by falling size. Gives (size, first rank of each run, shard of
    each run).
    """
    heap = [(0, s) for s in range(shards)]
    for size, count in histogram:
        taken = [0] * shards
        if count > 4 * shards and size > 0:
            heap, count = _pour(heap, size, count, taken)
        for _ in range(count):
            load, shard = heap[0]
            heapq.heapreplace(heap, (load + size, shard))
            taken[shard] += 1
        starts, owners, at = [], [], 0
        for shard, n in enumerate(taken):
            if n:
                starts.append(at)
                owners.append(shard)
                at += n
        yield size, starts, owners


def _planned(spark: SparkSession, histogram: DataFrame, shards: int) -> DataFrame:
    """The schedule as a table, written in pieces."""
    path = scratch_dir(spark, "shard-plan")
    plan = schedule(((r[0], r[1]) for r in histogram.orderBy(F.desc("group_size")).toLocalIterator()), shards)
    spark.createDataFrame([], PLAN).write.parquet(path)
    while piece := list(islice(plan, PLANNED)):
        spark.createDataFrame(piece, PLAN).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(PLAN).parquet(path)


def _pour(heap: list[tuple[int, int]], size: int, count: int, taken: list[int]) -> tuple[list[tuple[int, int]], int]:
    """The heap's choices for many groups of one size at once, but for the last few.

    Each shard offers the levels load, load + size, ...; the heap takes the lowest. So all levels up to the highest
    bound that offers no more than count are taken.
    """
    offered = lambda level: sum((level - load) // size + 1 for load, _ in heap if load <= level)
    low, high = min(heap)[0] - 1, max(heap)[0] + size * count
    while low < high:
        middle = (low + high + 1) // 2
        if offered(middle) <= count:
            low = middle
        else:
            high = middle - 1
    filled = []
    for load, shard in heap:
        n = (low - load) // size + 1 if load <= low else 0
        taken[shard] += n
        count -= n
        filled.append((load + n * size, shard))
    heapq.heapify(filled)
    return filled, count


def _rank(df: DataFrame, keys: list[str], order: list, spread, name: str, more: DataFrame | None = None) -> DataFrame:
    """Gapless number from 0 within keys, however many rows share them: rows are numbered within small buckets, and a
    running sum over the buckets' counts shifts them. more: a row for each value of keys, whose columns come along."""
    df = df.withColumn("_bucket", F.pmod(spread, F.lit(BUCKETS)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys, "_bucket").count().select(*keys, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    if more is not None:
        offsets = offsets.join(more, keys)
    within = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    numbered = df.withColumn("_number", F.row_number().over(within) - 1)
    return numbered.join(offsets, [*keys, "_bucket"]).withColumn(name, F.col("_before") + F.col("_number")).drop("_bucket", "_before", "_number")


def shard_documents(docs: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Shards 0..shards-1 of near-equal bytes; equal texts stay together.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard and the group's key and size. Defined cases: a null
    text counts as the empty one (size 16, crc 0, same group); repeated rows are rows of their own; a null doc_id is
    kept; other columns are ignored, whatever their names; an empty table gives no rows. Rows of a group that is larger
    than a fair share still stay together, so its shard then exceeds the others.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.md5(F.encode(body, "UTF-8")).alias("group_key"),
        ),
        "shard-rows",
    )
    groups = rows.groupBy("group_key").agg(F.sum("size").alias("group_size"), F.count("*").alias("copies"))
    groups = scratch(groups, "shard-groups")
    plan = _planned(docs.sparkSession, groups.groupBy("group_size").count(), shards)
    # a size brings its plan to its buckets of groups, so those of a common size are not in one task
    ranked = _rank(groups, ["group_size"], ["group_key"], F.xxhash64("group_key"), "rank", plan)
    run = F.size(F.filter("starts", lambda s: s <= F.col("rank")))
    placed = ranked.select("group_key", "group_size", "copies", F.element_at("owners", run).alias("shard"))
    assigned = scratch(join_spread(rows, placed, ["group_key"], "copies", hot_above(rows.count())).drop("copies"), "shard-assigned")
    out = _rank(assigned, ["shard"], ["doc_id", "group_key"], F.xxhash64("doc_id", "group_key"), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_key", "group_size")
