"""Connected components of an edge table, without gathering anything on the driver but two numbers for each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tarn.sources import scratch

FEW = 100_000


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of an edge reaches. Nodes without an edge are left out.

    Rounds of large-star and small-star: every node links its larger neighbours, then its smaller ones, to the smallest
    one it knows, until nothing changes. The minimum of a node's neighbours is a partial aggregate, so a hub of any degree
    costs a task one row for each of its input tasks. Whether a round has changed anything is seen from the number
    of edges and the exclusive or of their hashes, both counted while they are written.
    """
    edges, seen = _written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    while seen["n"]:
        before = seen
        both = edges.union(edges.select("v", "u"))
        if seen["n"] <= FEW:
            both = both.coalesce(1)  # in one task, without a shuffle
        larger = _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = _starred(larger)
        # a node and its smaller neighbours, all to the smallest; of a neighbour that is the smallest nothing is left
        links = smaller.select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, seen = _written(links.where("u != v").distinct())
        if seen == before:
            break
    hubs = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(hubs)


def _written(edges: DataFrame) -> tuple[DataFrame, dict]:
    seen = Observation()
    counted = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("hash"))
    return scratch(counted, "links"), seen.get


def _starred(edges: DataFrame) -> DataFrame:
    """Edges with m, the smallest of u and its neighbours."""
    return edges.join(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u")


def joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups after more links (a, b) between their nodes, or others: only the components that they touch are worked on."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}"))
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left")
    grown = scratch(components(ends.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))), "grown")
    alone = grown.join(groups.select("node"), "node", "left_anti")
    new = grown.select(F.col("node").alias("component"), F.col("component").alias("new"))
    moved = groups.join(new, "component", "left").select("node", F.coalesce("new", "component").alias("component"))
    return scratch(moved.unionByName(alone), "groups")
