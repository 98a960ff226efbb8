"""Exact nearest binary codes by incremental multi-index hashing.

A code is cut into segments, each with a table from value to codes. By the pigeonhole principle a code within Hamming
distance m * (r + 1) - 1 of a query agrees with it up to r bits in one of its m segments. So the search looks up, segment
by segment, all values within radius r, verifies the whole codes found there, and grows r until the kth best verified
distance is covered.

Equal codes are one entry. A segment's table is dealt over cells by the first bits of the value, as many as keep a cell
within ENTRIES on average, and a cell that holds more is split by hash. A query goes to the cells that values within the
radius lie in, with the kth best distance that it knows so far; a cell answers with its best entries, not with its pairs.
Queries that are covered stop. So every round moves each entry once for each segment, and each open query to a number of
cells that grows with the logarithm of the table; no entry is copied for other queries. Queries whose neighbours are so
far off that radius LAST does not cover them look at all codes, in blocks: by then most of a table's values would be
looked up anyway.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.vectors import best, best_entries, smallest_ids, usable
from tarn.sources import scratch

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
#: Entries of a cell, and queries that meet it at once.
ENTRIES, QUERIES = 32_768, 4_096
#: Radii of each round; the last one does not look up values but every code.
ROUNDS = ((0, 1), (2,), (3,))


@lru_cache(maxsize=None)
def flips(radius: int, width: int = WIDTH) -> np.ndarray:
    """All masks of so many of the width's bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(width), radius)], "int64")


class Table:
    """One segment's table of a block of distinct codes, by segment value."""

    def __init__(self, codes: np.ndarray, first: np.ndarray, n: np.ndarray, segment: int):
        part = (codes >> np.uint64(WIDTH * segment)).astype("int64") & ((1 << WIDTH) - 1)
        order = np.argsort(part, kind="stable")
        self.part, self.codes, self.first, self.n, self.segment = part[order], codes[order], first[order], n[order], segment

    def within(self, query: int, radii: tuple[int, ...]) -> np.ndarray:
        """Places of the codes whose segment differs from the query's in so many bits."""
        value = query >> WIDTH * self.segment & ((1 << WIDTH) - 1)
        masks = np.concatenate([flips(r) for r in radii])
        if len(masks) > len(self.part):
            return np.flatnonzero(np.isin(np.bitwise_count(self.part ^ value), radii))
        low, high = np.searchsorted(self.part, value ^ masks, "left"), np.searchsorted(self.part, value ^ masks, "right")
        low, many = low[high > low], (high - low)[high > low]
        return np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())

    def nearest(self, query: int, places: np.ndarray, k: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the places, those that best_entries() would keep, no farther than bound: and their distances."""
        distance = np.bitwise_count(self.codes[places] ^ np.uint64(query)).astype("int64")
        places, distance = places[distance <= bound], distance[distance <= bound]
        order = np.lexsort((self.first[places], distance))
        places, distance = places[order], distance[order]
        new = np.zeros(len(places), bool)
        new[np.unique(self.first[places], return_index=True)[1]] = True
        keep = (np.cumsum(new) - new < k) & (new | (self.n[places] > 1))
        return places[keep], distance[keep]


def _look(k: int, radii: tuple[int, ...] | None):
    """Each query's best entries of a cell. radii: None for all codes."""

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            table = Table(entries["code"].to_numpy().view("uint64"), entries["first"].to_numpy(), entries["n"].to_numpy(), int(entries["segment"].iloc[0]))
            for query, bound in zip(queries["query"].to_numpy().view("uint64").tolist(), queries["bound"].tolist(), strict=True):
                places = np.arange(len(table.codes)) if radii is None else table.within(query, radii)
                places, distance = table.nearest(query, places, k, bound)
                out.append((np.full(len(places), query, "uint64").view("int64"), table.codes[places].view("int64"), table.first[places], table.n[places], distance.astype("int32")))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in ("int64", "int64", "int64", "int64", "int32")]
        return pd.DataFrame(dict(zip(("query", "code", "first", "n", "distance"), columns, strict=True)))

    return run


FOUND = "query long, code long, first long, n long, distance int"


def sign_codes(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, code, dims): bit i is 1 where component i is above zero, for usable vectors; dims is how many components
    there are, as codes of different ones are no neighbours. Wider vectors than a code are refused."""
    rows = usable(vectors, vec_id, vector)
    wide = F.raise_error(F.format_string(f"vectors of %d components do not fit a code of {BITS} bits", F.size("v"))).cast("array<double>")
    bits = F.transform(F.when(F.size("v") > BITS, wide).otherwise(F.col("v")), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    # bits are disjoint, so OR-ing them is exact also for the sign bit
    return rows.select("vec_id", F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)).alias("code"), F.size("v").alias("dims"))


def _segment(code: str, segment: Column) -> Column:
    return F.call_function("shiftrightunsigned", F.col(code), (segment * WIDTH).cast("int")).bitwiseAND(F.lit((1 << WIDTH) - 1).cast("long"))


def _cells(entries: DataFrame, n: int) -> tuple[DataFrame, DataFrame, int]:
    """The entries of each segment with their cell and part; the parts of each cell; and how many bits name a cell."""
    bits = min(WIDTH, max(0, (n - 1).bit_length() - (ENTRIES - 1).bit_length()))
    placed = entries.withColumn("segment", F.explode(F.array(*map(F.lit, range(SEGMENTS)))))
    placed = placed.withColumn("cell", F.shiftright(_segment("code", F.col("segment")), WIDTH - bits).cast("int"))
    parts = placed.groupBy("segment", "cell").agg(F.ceil(F.count("*") / ENTRIES).cast("int").alias("parts"))
    return placed, scratch(parts, "code-cells"), bits


def _routed(queries: DataFrame, parts: DataFrame, bits: int, radius: int) -> DataFrame:
    """The open queries at each part of each cell that a value within the radius may lie in."""
    masks = np.concatenate([flips(r, bits) for r in range(min(radius, bits) + 1)]).tolist()
    to = queries.withColumn("segment", F.explode(F.array(*map(F.lit, range(SEGMENTS))))).withColumn("mask", F.explode(F.array(*[F.lit(int(m)) for m in masks])))
    to = to.withColumn("cell", F.shiftright(_segment("query", F.col("segment")), WIDTH - bits).cast("int").bitwiseXOR(F.col("mask").cast("int")))
    # parts has at most SEGMENTS << WIDTH rows
    return to.join(F.broadcast(parts), ["segment", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("segment", "cell", "part", "query", "bound")


def _merged(found: DataFrame, k: int) -> DataFrame:
    return best_entries(found.dropDuplicates(["query", "code"]), ["query"], [F.col("distance"), F.col("first"), F.col("code")], k)


def _bounds(kept: DataFrame, k: int, unique: bool) -> DataFrame:
    """(query, far): the distance within which k ids are known; null where fewer are. unique: no id has two codes."""
    of_query, of_first = Window.partitionBy("query").orderBy("distance"), Window.partitionBy("query", "first").orderBy("distance", "code")
    gain = F.col("n") if unique else (F.row_number().over(of_first) == 1).cast("long")
    held = kept.withColumn("gain", gain).withColumn("held", F.sum("gain").over(of_query))
    return held.groupBy("query").agg(F.min(F.when(F.col("held") >= k, F.col("distance"))).alias("far"))


def _searched(codes: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query, code, distance): for each query's code the entries that hold its k nearest ids."""
    counts = codes.groupBy("code").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))
    unique = codes.groupBy("vec_id").count().where("count > 1").isEmpty()
    entries = scratch(counts, "code-entries")
    n = entries.count()
    placed, parts, bits = _cells(entries, n)
    placed = scratch(placed.join(F.broadcast(parts), ["segment", "cell"]).withColumn("part", F.pmod(F.xxhash64("code"), "parts").cast("int")).drop("parts"), "code-tables")
    wanted = scratch(codes.where(is_query).select(F.col("code").alias("query")).distinct(), "code-queries")
    open_queries, kept, done = wanted.withColumn("bound", F.lit(BITS)), None, []
    for radii in ROUNDS:
        to = _routed(open_queries, parts, bits, max(radii))
        # queries of one cell come in teams of bounded size; a cell is copied for the teams that it has
        teams = to.groupBy("segment", "cell", "part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("teams"))
        left = placed.join(teams, ["segment", "cell", "part"]).withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1))).drop("teams")
        right = to.join(teams, ["segment", "cell", "part"]).withColumn("team", F.pmod(F.xxhash64("query"), "teams").cast("int")).drop("teams")
        at = ["segment", "cell", "part", "team"]
        found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_look(k, radii), FOUND)
        kept = scratch(_merged(found if kept is None else found.unionByName(kept), k), "code-found")
        state = open_queries.select("query").join(_bounds(kept, k, unique), "query", "left")
        covered = F.coalesce(F.col("far") <= SEGMENTS * (max(radii) + 1) - 1, F.lit(False))
        state = scratch(state.select("query", covered.alias("covered"), F.coalesce("far", F.lit(BITS)).cast("int").alias("bound")), "code-state")
        done.append(kept.join(state.where("covered").select("query"), "query", "left_semi"))
        open_queries = state.where("not covered").select("query", "bound")
        kept = kept.join(open_queries.select("query"), "query", "left_semi")
        if open_queries.isEmpty():
            break
    else:
        # every code once, in blocks: the first segment's table holds each in one cell
        blocks = placed.where("segment = 0").withColumn("block", F.pmod(F.xxhash64("code"), F.lit(max(1, -(-n // ENTRIES)))).cast("int"))
        teams = max(1, -(-open_queries.count() // QUERIES))
        left = blocks.withColumn("team", F.explode(F.sequence(F.lit(0), F.lit(teams - 1))))
        right = open_queries.withColumn("team", F.pmod(F.xxhash64("query"), F.lit(teams)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-n // ENTRIES)) - 1))))
        found = left.groupBy("block", "team").cogroup(right.groupBy("block", "team")).applyInPandas(_look(k, None), FOUND)
        done.append(_merged(found, k))
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out.select("query", "code", "distance")


def nearest_codes(codes: DataFrame, is_query: Column, k: int) -> DataFrame:
    """The k nearest rows by Hamming distance for each query among codes (vec_id, code and, where there are, dims), exactly.

    Candidates are all rows with another vec_id; ties go to the smaller vec_id; all candidates, if fewer. Returns
    query_id, rank, vec_id, distance. Defined cases: rows with a null id or code take no part; a repeated row counts
    once; a vec_id with several codes is one candidate, at its nearest, and as a query has the nearest of any of them;
    codes of other dims are no candidates; an empty table gives no rows; equal codes share an entry, however many.
    """
    held = codes if "dims" in codes.columns else codes.withColumn("dims", F.lit(BITS))
    held = scratch(held.where("vec_id is not null and code is not null").select("vec_id", "code", "dims").distinct(), "codes")
    out = None
    for dims in sorted(r[0] for r in held.select("dims").distinct().collect()):  # BITS at most
        own = held.where(F.col("dims") == dims)
        queries = own.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("code").alias("query"))
        # one more, as the query's own id may be among them
        found, ids = _searched(own, is_query, k + 1), smallest_ids(own, ["code"], k + 1)
        rows = queries.join(found, "query").join(ids, "code").select("query_id", "distance", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
        rows = rows.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return codes.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, distance int")
    out = out.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    return best(out, ["query_id"], [F.col("distance"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "distance")
