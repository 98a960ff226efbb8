"""Approximate nearest neighbours by cosine: an inverted file with product-quantised residuals.

Equal vectors are one entry. On a bounded sample of entries (documented parameters) k-means finds the coarse centroids
and, on residuals, the codebooks of each pair of dimensions; the sample's own neighbours set how many lists are probed
for the recall wanted. Every entry is then indexed: its list and one byte a pair of dimensions. A query adds up its
asymmetric distance tables over the codes of the lists it probes. An entry's distance is that of its code, give or take
the entry's own quantisation error; so all entries that may be among the best are reranked, however many they are, with
exact cosines of the original vectors in double precision.

There are as many lists as half the square root of the entries (MOST_LISTS at most, of PER_LIST sample entries each).
Lists are packed into cells of bounded size (a list too long is dealt over several). Queries of one cell make a team, or
several of bounded size; a cell is copied only for the teams with a query that probes it, and these are its neighbours
among the cells. It gives a query's best entries of the cell, not its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.skew import least_hashed
from tarn.llm.vectors import best, best_entries, smallest_ids, usable
from tarn.sources import scratch

SAMPLE, PER_LIST, MOST_LISTS = 16_384, 32, 1 << 14
TRIALS, RECALL = 256, 0.99
CELL, TEAM = 16_384, 2_048
CODEWORDS = 256
#: Of a squared distance of unit vectors, what single precision may lose.
ROUNDING = 1e-5


def kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """At most k centroids."""
    k = min(k, len(points))
    centroids = points[rng.choice(len(points), k, replace=False)].copy()
    for _ in range(rounds):
        owner = closest(points, centroids)
        counts = np.bincount(owner, minlength=k)
        sums = np.stack([np.bincount(owner, weights=points[:, d], minlength=k) for d in range(points.shape[1])], 1)
        full = counts > 0
        centroids[full] = sums[full] / counts[full, None]
    return centroids


def closest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    bias = 0.5 * (centroids**2).sum(1)
    return np.concatenate([np.zeros(0, "int64"), *((points[a : a + 4096] @ centroids.T - bias).argmax(1) for a in range(0, len(points), 4096))])


@dataclass
class Model:
    coarse: np.ndarray  # lists x dimensions
    books: np.ndarray  # pairs of dimensions x codewords x 2
    probes: int

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list and code of each unit vector."""
        owner = closest(x, self.coarse)
        rest = padded(x - self.coarse[owner])
        codes = np.stack([closest(rest[:, 2 * s : 2 * s + 2], book) for s, book in enumerate(self.books)], 1).astype("uint8")
        return owner, codes

    def decode(self, owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that lists and codes stand for."""
        rest = np.concatenate([book[codes[:, s]] for s, book in enumerate(self.books)], 1)
        return self.coarse[owner] + rest[:, : self.coarse.shape[1]]

    def order(self, x: np.ndarray) -> np.ndarray:
        """Lists from the nearest on, for each vector."""
        return np.argsort(0.5 * (self.coarse**2).sum(1) - x @ self.coarse.T, axis=1, kind="stable")

    def tables(self, x: np.ndarray) -> np.ndarray:
        """Inner products of each vector's pairs of dimensions with all codewords."""
        pairs = padded(x).reshape(len(x), -1, 2)
        return np.einsum("qsd,scd->qsc", pairs, self.books).astype("float32")


def padded(x: np.ndarray) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, x.shape[1] % 2)))


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, "float64")
    x = x / np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype("float32")


def lists_for(entries: int) -> int:
    return min(MOST_LISTS, 1 << max(0, round(np.log2(max(1.0, np.sqrt(entries) / 2)))))


def train(sample: np.ndarray, entries: int, k: int, seed: int = 7) -> Model:
    """Fits the index on a sample of unit vectors; entries: how many will be indexed."""
    rng = np.random.default_rng(seed)
    lists = lists_for(entries)
    coarse = kmeans(sample, lists, rng)
    rest = padded(sample - coarse[closest(sample, coarse)])
    books = np.zeros((rest.shape[1] // 2, CODEWORDS, 2), "float32")
    for s in range(len(books)):
        book = kmeans(rest[:, 2 * s : 2 * s + 2], CODEWORDS, rng, 6)
        books[s, : len(book)] = book
        books[s, len(book) :] = book[-1]
    model = Model(coarse, books, len(coarse))
    if len(sample) > 4 * k * TRIALS:
        trial = rng.choice(len(sample), TRIALS, replace=False)
        true = []
        for one in trial:
            score = sample @ sample[one]
            score[one] = -2
            true.append(np.argpartition(-score, k)[:k])
        true = np.array(true)
        owner, place = closest(sample, coarse), np.argsort(model.order(sample[trial]), axis=1)
        at = np.sort(np.take_along_axis(place, owner[true], 1).ravel())
        model.probes = int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1
    return model


def pack(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Lists into cells of at most CELL entries: each list's first cell and how many it is dealt over."""
    out, cell, room = {}, 0, CELL
    for key, n in sorted(counts.items()):
        if n > CELL:
            parts = -(-n // CELL)
            cell += room < CELL
            out[key] = (cell, parts)
            cell, room = cell + parts, CELL
        else:
            if n > room:
                cell, room = cell + 1, CELL
            out[key] = (cell, 1)
            room -= n
    return out


def _index(model: Model):
    def run(batches):
        for batch in batches:
            x = unit(_matrix(batch.column(4))) if batch.num_rows else np.zeros((0, model.coarse.shape[1]), "float32")
            owner, codes = model.assign(x)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(owner, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary())], names=["k1", "k2", "first", "n", "v", "list", "code"])

    return run


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _route(model: Model, cells: dict[int, tuple[int, int]], counts: dict[int, int], k: int):
    """A row for each query and cell that it goes to, with the lists to look at there; its own list is one of them."""
    sizes = np.array([counts.get(i, 0) for i in range(len(model.coarse))])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = model.order(unit(_matrix(batch.column(2))))
            rows, where, what = [], [], []
            for i, (lists, own) in enumerate(zip(order, batch.column(3).to_pylist(), strict=True)):
                enough = int(np.searchsorted(np.cumsum(sizes[lists]), 4 * (k + 1))) + 1
                goes: dict[int, list[int]] = {}
                for one in dict.fromkeys([own, *lists[: max(model.probes, enough)].tolist()]):
                    first, parts = cells.get(one, (0, 0))
                    for c in range(first, first + parts):
                        goes.setdefault(c, []).append(one)
                for c, look in goes.items():
                    rows.append(i)
                    where.append(c)
                    what.append(look)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(j).take(at) for j in (0, 1, 2, 4)), pa.array(where, pa.int32()), pa.array(what, pa.list_(pa.int32()))], names=["q1", "q2", "v", "home", "cell", "lists"])

    return run


def within(square: np.ndarray, error: np.ndarray, n: int) -> np.ndarray:
    """Places of all that may be among the n nearest: squared distances of codes, and how far a code is from its vector."""
    if len(square) <= n:
        return np.arange(len(square))
    reach = np.partition(np.sqrt(np.maximum(square, 0) + ROUNDING) + error, n - 1)[n - 1]
    return np.flatnonzero(np.sqrt(np.maximum(square - ROUNDING, 0)) - error <= reach)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: cosines are those of the rows, to the last
    bit, and no square is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(-1, keepdims=True))[1])


def _probe(model: Model, n: int, unique: bool):
    """Each query's best entries of a cell, those of n ids: cosines of the original vectors, in double precision."""
    kinds = {"q1": "int64", "q2": "int64", "k1": "int64", "k2": "int64", "first": "int64", "n": "int64", "score": "float64"}

    def run(entries: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(entries) and len(queries):
            owner = entries["list"].to_numpy()
            codes = np.frombuffer(b"".join(entries["code"]), "uint8").reshape(len(entries), -1)
            k1, k2, first, many = (entries[c].to_numpy() for c in ("k1", "k2", "first", "n"))
            vectors = scaled(np.stack(entries["v"]))
            length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
            stands = model.decode(owner, codes)
            error = np.linalg.norm(unit(vectors) - stands, axis=1)
            norms = np.einsum("ij,ij->i", stands, stands)
            del stands
            for start in range(0, len(queries), 64):
                some = queries.iloc[start : start + 64]
                x = unit(np.stack(some["v"]))
                near = (x @ model.coarse.T)[:, owner]
                tables = model.tables(x)
                for s in range(codes.shape[1]):
                    near += tables[:, s, codes[:, s]]
                for i, (q1, q2, v, lists) in enumerate(zip(some["q1"], some["q2"], some["v"], some["lists"], strict=True)):
                    looked = np.zeros(len(model.coarse), bool)
                    looked[lists] = True
                    at = np.flatnonzero(looked[owner])
                    if unique:  # else entries may share ids, and n of them need not hold n
                        at = at[within(1 + norms[at] - 2 * near[i, at], error[at], n)]
                    v = scaled(v)
                    score = np.einsum("ij,j->i", vectors[at], v) / (np.sqrt(np.einsum("j,j->", v, v)) * length[at])
                    top = np.lexsort((first[at], -score))
                    new = np.zeros(len(top), bool)
                    new[np.unique(first[at[top]], return_index=True)[1]] = True
                    top = top[(np.cumsum(new) - new < n) & (new | (many[at[top]] > 1))]
                    at = at[top]
                    out.append((np.full(len(at), q1), np.full(len(at), q2), k1[at], k2[at], first[at], many[at], score[top]))
        columns = zip(*out, strict=True) if out else [[np.zeros(0, t)] for t in kinds.values()]
        return pd.DataFrame({c: np.concatenate(parts).astype(t) for (c, t), parts in zip(kinds.items(), columns, strict=True)})

    return run


def nearest_vectors(vectors: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Each query's k nearest rows found, by cosine: query_id, rank, vec_id, score.

    is_query is a condition on vec_id. Candidates are all rows with another vec_id; ties go to the smaller vec_id.
    Defined cases: null ids, and vectors that are null, zero or of non-finite or null components take no part; vectors of
    different lengths have no cosine, so those of each length have an index of their own; a repeated row counts once; a
    vec_id with several vectors is one candidate, at its nearest, and as a query has the nearest of any of them; equal
    vectors are one entry of any number of rows; an empty table gives no rows; other columns are ignored. The fit uses at
    most SAMPLE entries of smallest hash, or PER_LIST for each list; every entry is indexed.
    """
    rows = usable(vectors, vec_id, vector).select("vec_id", "v", F.size("v").alias("dims"), F.xxhash64("v").alias("k1"), F.xxhash64("v", F.lit(1)).alias("k2"))
    rows = scratch(rows, "vectors")
    out = None
    for dims in sorted(r[0] for r in rows.select("dims").distinct().collect()):  # most tables have one
        found = _searched(rows.where(F.col("dims") == dims).drop("dims"), is_query, k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best(out, ["query_id"], [F.desc("score"), F.col("vec_id")], k).select("query_id", "rank", "vec_id", "score")


def _searched(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """(query_id, vec_id, score) of at least each query's k best candidates found, among vectors of one length."""
    spark = rows.sparkSession
    entries = scratch(rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("first"), F.count_distinct("vec_id").alias("n"), F.first("v").alias("v")), "vector-entries")
    unique = rows.groupBy("vec_id").agg(F.count_distinct("k1", "k2").alias("n")).where("n > 1").isEmpty()
    count = entries.count()
    sample = least_hashed(entries, ["k1", "k2"], max(SAMPLE, PER_LIST * lists_for(count)), count).select("v").toArrow().column("v").combine_chunks()
    model = train(unit(_matrix(sample)), count, k)
    index = scratch(entries.select("k1", "k2", "first", "n", "v").mapInArrow(_index(model), "k1 long, k2 long, first long, n long, v array<double>, list int, code binary"), "vector-index")
    counts = {r["list"]: r["count"] for r in index.groupBy("list").count().collect()}  # a row for each coarse centroid
    cells = pack(counts)
    where = F.broadcast(spark.createDataFrame([(key, first, parts) for key, (first, parts) in cells.items()], "list int, home int, parts int"))
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("k1").alias("q1"), F.col("k2").alias("q2")).distinct()
    wanted = queries.select("q1", "q2").distinct().join(index.select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), "v", "list"), ["q1", "q2"])
    routes = wanted.join(where, "list").select("q1", "q2", "v", "list", "home").mapInArrow(_route(model, cells, counts, k), "q1 long, q2 long, v array<double>, home int, cell int, lists array<int>")
    routes = scratch(routes, "vector-routes")
    # a team: queries of one home, at most TEAM on average for any cell
    teams = routes.groupBy("home", "cell").agg(F.ceil(F.count("*") / TEAM).cast("int").alias("teams"))
    pairs = teams.withColumn("team", F.explode(F.sequence(F.lit(0), F.col("teams") - 1))).select(F.col("home").alias("home"), F.col("cell").alias("cell"), "team")
    left = index.join(where, "list").select("k1", "k2", "first", "n", "v", "list", "code", (F.col("home") + F.pmod("k1", "parts")).cast("int").alias("cell")).join(pairs, "cell")
    right = routes.join(teams, ["home", "cell"]).withColumn("team", F.pmod(F.xxhash64("q1", "q2"), "teams").cast("int")).drop("teams")
    at = ["cell", "home", "team"]
    met = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(_probe(model, k + 1, unique), "q1 long, q2 long, k1 long, k2 long, first long, n long, score double")
    top = best_entries(met, ["q1", "q2"], [F.desc("score"), F.col("first"), F.col("k1"), F.col("k2")], k + 1).select("q1", "q2", "k1", "k2", "score")
    top = top.join(smallest_ids(rows, ["k1", "k2"], k + 1), ["k1", "k2"])
    return queries.join(top, ["q1", "q2"]).select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id != query_id")
