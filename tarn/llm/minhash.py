"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct shingles. Two permutations of the 32-bit numbers give all coordinates: the first
scatters the shingles, the second, circularly shifted by k, orders them for coordinate k, and the coordinate is the
least position. Bands of consecutive coordinates make the buckets; links are confirmed on full sets.

No bucket is expanded into its pairs. Equal sets are one node from the start. Then each bucket's nodes are compared with
the bucket's least node, and linked nodes become components. What is left are pairs of different components within a
bucket, so one of them is outside the bucket's largest component. These are compared in blocks of bounded size, and of
set sizes that allow a link, by sets of 32-bit hashes, which give an upper bound of the similarity. First each node
proposes its nearest one of another component in its block, which joins most of a group; then the nodes outside the
largest component meet all blocks of the bucket, and all pairs are proposed that still cross components and may reach the
threshold. Proposals are confirmed on full sets. So a large group of near copies moves its nodes and their links between
components, not its pairs, and no link between two components is lost. A bucket may hold any share of the nodes: those of
many nodes are known by broadcast and not dealt out by bucket.

With 32 bands of 4 rows a pair at similarity 0.75 shares no bucket with probability 5e-6, and one at 0.85 with 5e-11.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.components import components, joined
from tarn.llm.hashing import chunks, distinct, mix, shingle_hashes, word_hashes
from tarn.llm.skew import hot_above, join_spread
from tarn.sources import scratch

ROWS, BANDS = 4, 32
COORDINATES = ROWS * BANDS
BLOCK = 256
#: Columns of a block's incidence matrix that are held at once.
COLUMNS = 4_096
_u = np.uint32


def scatter(x: np.ndarray) -> np.ndarray:
    """The first permutation, of 32-bit numbers."""
    x = (x ^ (x >> _u(16))) * _u(0x7FEB352D)
    x = (x ^ (x >> _u(15))) * _u(0x846CA68B)
    return x ^ (x >> _u(16))


def ordering(x: np.ndarray) -> np.ndarray:
    """The second permutation, of 32-bit numbers. Works in x's own memory."""
    x *= _u(0x9E3779B1)
    x ^= x >> _u(15)
    x *= _u(0x85EBCA77)
    x ^= x >> _u(13)
    x *= _u(0xC2B2AE3D)
    return x


def signatures(shingles: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of coordinates for each text with shingles (offsets must rise)."""
    x = scatter((shingles >> np.uint64(32)).astype("uint32"))
    out = np.empty((len(offsets) - 1, COORDINATES), "uint32")
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(ordering(x - _u(k)), offsets[:-1])
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """The bucket of each band, as a 64-bit number that includes the band."""
    parts = signature.reshape(len(signature), BANDS, ROWS).astype("uint64")
    key = np.full(parts.shape[:2], np.uint64(0)) + np.arange(BANDS, dtype="uint64")
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view("int64")


SKETCH = "doc_id long, r1 long, r2 long, n_shingles long, h1 long, h2 long, keys array<long>"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            values, offsets = distinct(*shingle_hashes(*word_hashes(part.column(1))))
            sizes = np.diff(offsets)
            full = np.flatnonzero(sizes)
            keys, marks = np.zeros((0, BANDS), "int64"), np.zeros((2, len(sizes)), "int64")
            if len(full):
                starts = offsets[:-1][full]
                for half in range(2):
                    sums = np.add.reduceat(mix(values + np.uint64(half * 0x51_7C_C1_B7_27_22_0A_95)), starts)
                    marks[half, full] = mix(sums * np.uint64(31) + sizes[full].astype("uint64")).view("int64")
                keys = bands(signatures(values, np.append(starts, len(values))))
            none = sizes == 0
            counts = np.append(0, np.cumsum(np.where(none, 0, BANDS))).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), *(pa.array(m, pa.int64(), mask=none) for m in marks),
                    pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(keys.ravel(), pa.int64())),
                ],
                names=SKETCH.replace(" long", "").replace(" array<long>", "").split(", "),
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, 1):
            values, offsets = distinct(*shingle_hashes(*word_hashes(part.column(1))))
            rows = [values[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            short = [np.unique((r >> np.uint64(32)).astype("uint32")).tobytes() for r in rows]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(short, pa.binary())], names=["node", "shingles", "short"])


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(i) for i in range(4))
            keep = []
            for x, y in zip(left, right, strict=True):
                x, y = (np.frombuffer(v.as_buffer(), "uint64") for v in (x, y))
                both = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return run


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[left] with sets[right]."""
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column) > 1
    place = np.cumsum(often) - 1
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    row, column = row[often[column]], place[column[often[column]]]
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((len(left), len(right)), "float32")
    for start in range(0, int(often.sum()), COLUMNS):
        a, b = np.searchsorted(column, (start, start + COLUMNS))
        held = np.zeros((len(sets), COLUMNS), "float32")
        held[row[a:b], column[a:b] - start] = 1
        out += held[left] @ held[right].T
    return out.astype("int64")


def _compare(percent: int, nearest: bool):
    """Pairs of a bucket's blocks that may be links and would join two components: rows sorted by bucket and blocks.

    nearest: of each node's pairs only the most alike one. side: 0 for rows of the first block, 1 of the second, 2 of both.
    """

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows).combine_chunks()
        node, component, size, side = (table.column(c).to_numpy() for c in ("node", "component", "n_shingles", "side"))
        pivot, band = (table.column(c)[0].as_py() for c in ("pivot", "band"))
        found: set[tuple[int, int]] = set()
        left, right = (np.flatnonzero((side != other) & (node != pivot)) for other in (1, 0))
        if len(left) and len(right) and len(np.unique(component)) > 1:
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), BANDS)
            sets = [np.frombuffer(x, "uint32") for x in table.column("short").to_pylist()]
            lost = size - np.array([len(x) for x in sets])  # shingles that share their 32 bits with another of the set
            both = common(sets, left, right) + np.minimum.outer(lost[left], lost[right])
            total = size[left][:, None] + size[right][None] - both
            alike = (100 * both >= percent * total) & (component[left][:, None] != component[right][None])
            for i, j in zip(*np.nonzero(alike), strict=True):
                # once for each pair: in its first bucket
                alike[i, j] = (keys[left[i]] == keys[right[j]]).argmax() == band
            score = np.where(alike, both / total, 0)
            if nearest:
                at = [(i, int(score[i].argmax())) for i in np.flatnonzero(alike.any(1))]
            else:
                at = list(zip(*np.nonzero(alike), strict=True))
            found.update((min(x, y), max(x, y)) for x, y in ((int(node[left[i]]), int(node[right[j]])) for i, j in at))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in found], pa.int64()), pa.array([p[1] for p in found], pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            marks = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("key", "one", "two")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                mark = tuple(marks[:, a].tolist())
                if held and mark != last:
                    yield pairs(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = mark
        if held:
            yield pairs(held)

    return run


def _across(members: DataFrame, groups: DataFrame, about: DataFrame, percent: int, nearest: bool, limit: int) -> DataFrame:
    """Pairs (a, b) of one bucket but two components that may be links, other than those with the bucket's pivot.

    nearest: within blocks only, and the most alike for each node; else all.
    """
    # set sizes of linked nodes are of one class or of two that are next to each other; a little wider, for rounding
    width = 1.001 * math.log(100 / min(percent, 99))
    grouped = members.where("n > 2").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    grouped = scratch(grouped.withColumn("class", F.floor(F.log("n_shingles") / width).cast("int")), "grouped")
    kinds = grouped.groupBy("key", "component").agg(F.count("*").alias("own"), F.max("n").alias("n"), F.collect_set("class").alias("classes"))
    mixed = kinds.groupBy("key").agg(F.max(F.struct("own", "component")).alias("top"), F.sum("own").alias("all"), F.count("*").alias("kinds"), F.max("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("classes"))).alias("classes"))
    mixed = mixed.where("kinds > 1").select("key", "n", "classes", F.col("top.component").alias("main"), (F.col("all") - F.col("top.own")).alias("minor"))
    rest = join_spread(grouped, mixed, ["key"], "n", limit, own=True).join(about, "node")
    block = lambda classes, number: classes.cast("long") * 1_000_000 + number
    dealt = lambda parts: F.pmod(F.xxhash64("node", "key"), parts).cast("long")
    blocks, minor = F.ceil(F.col("n") / BLOCK), F.ceil(F.col("minor") / BLOCK)
    out = ["key", "band", "pivot", "node", "component", "n_shingles", "keys", "short"]
    if nearest:
        rest = rest.select(*out, block(F.col("class"), dealt(blocks)).alias("one"), F.lit(2).alias("side")).withColumn("two", F.col("one"))
    else:
        near = F.array_intersect(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.col("class") + d), F.col("classes"))
        every = lambda parts: F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0).cast("long"), parts.cast("long") - 1), lambda k: block(c, k))))
        first = rest.where("component != main").select(*out, block(F.col("class"), dealt(minor)).alias("one"), F.lit(0).alias("side"), F.explode(every(blocks)).alias("two"))
        rest = first.unionByName(rest.select(*out, block(F.col("class"), dealt(blocks)).alias("two"), F.lit(1).alias("side"), F.explode(every(minor)).alias("one")))
    rest = rest.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two")
    return scratch(rest.mapInArrow(_compare(percent, nearest), "a long, b long").distinct(), "more-pairs")


def row_key(doc_id: str, text: str) -> list[Column]:
    """A row's identity, r1 and r2: 128 bits of hash of its doc_id and text, nulls included."""
    row = (F.col(doc_id).cast("long"), F.col(text), F.col(doc_id).isNull(), F.col(text).isNull())
    return [F.xxhash64(F.lit(half), *row).alias(f"r{half}") for half in (1, 2)]


def _verify(candidates: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    return candidates.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(_confirm(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Groups of documents whose sets of 5-word shingles are alike, directly or through others.

    Links hold where 100 * intersection >= percent * union. Returns one row per document: doc_id, n_shingles,
    component_id (the smallest doc_id of its group), kept (doc_id is that one), and r1, r2 and component for joining the
    result to its rows. Defined cases: a text of fewer than five words has its whole sequence as one shingle; a null, empty
    or blank text has none, is linked with nothing and kept; repeated rows are in one group and each keeps its row; a null
    doc_id takes part, and is kept only in a group without any other; other columns are ignored; an empty table gives no
    rows. Equal sets are told by 128 bits of hash, and then have a number of their own.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    sketches = scratch(rows.mapInArrow(_sketch, SKETCH), "sketches")
    total = sketches.count()
    worded = sketches.where("h1 is not null")
    nodes = worded.groupBy("h1", "h2").agg(F.min(F.struct("r1", "r2")).alias("row"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.count("*").alias("copies"))
    nodes = scratch(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", "n_shingles", F.posexplode("keys").alias("band", "key"))
    buckets = keys.groupBy("key").agg(F.min(F.struct("node", "n_shingles")).alias("first"), F.count("*").alias("n")).where("n > 1")
    buckets = scratch(buckets.select("key", "n", F.col("first.node").alias("pivot"), F.col("first.n_shingles").alias("of_pivot")), "buckets")
    limit = hot_above(BANDS * nodes.count())
    members = scratch(join_spread(keys, buckets, ["key"], "n", limit), "members")
    fits = 100 * F.least("of_pivot", "n_shingles") >= percent * F.greatest("of_pivot", "n_shingles")
    first = members.where(F.col("node") != F.col("pivot")).where(fits).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    # a node's text is that of one of its rows, so a group of copies brings one text
    wanted = members.select("node").distinct().join(nodes.select("node", "row.*"), "node")
    sets = wanted.join(rows.select("r1", "r2", "text"), ["r1", "r2"]).dropDuplicates(["node"]).select("node", "text")
    sets = scratch(sets.mapInArrow(_sets, "node long, shingles binary, short binary"), "sets")
    about = nodes.select("node", "keys").join(sets.select("node", "short"), "node")
    groups = components(scratch(_verify(first, sets, percent), "first-links"))

    for nearest in (True, False):
        more = scratch(_verify(_across(members, groups, about, percent, nearest, limit), sets, percent), "more-links")
        if not more.isEmpty():
            groups = joined(groups, more)

    placed = nodes.select("h1", "h2", "copies", "node").join(groups, "node", "left").select("h1", "h2", "copies", F.coalesce("component", "node").alias("component"))
    placed = scratch(join_spread(worded.drop("keys"), placed, ["h1", "h2"], "copies", hot_above(total)).drop("copies", "h1", "h2"), "placed")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n"))
    out = join_spread(placed, least, ["component"], "n", hot_above(total)).drop("n")
    alone = sketches.where("h1 is null").select(F.lit(None).cast("long").alias("component"), "doc_id", "r1", "r2", "n_shingles", F.col("doc_id").alias("component_id"))
    out = out.unionByName(alone)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "r1", "r2", "component")


def one_each(docs: DataFrame, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all their columns, but one row of each group: that of its smallest doc_id.

    Rows with the same doc_id and text count once, also those without words; a group without any doc_id keeps one row.
    """
    found = near_duplicates(docs, percent, doc_id, text).where("kept")
    grouped = found.where("component is not null").groupBy("component").agg(F.min(F.struct("r1", "r2")).alias("row")).select("row.*")
    alone = found.where("component is null").select("r1", "r2").distinct()
    key = [c.alias(f"_{k}") for k, c in zip(("r1", "r2"), row_key(doc_id, text), strict=True)]
    rows = docs.select(F.struct("*").alias("_row"), *key)
    kept = grouped.union(alone).select(F.col("r1").alias("_r1"), F.col("r2").alias("_r2"))
    return rows.join(kept, ["_r1", "_r2"], "left_semi").dropDuplicates(["_r1", "_r2"]).select("_row.*")
