"""Quality by importance resampling.

Two hashed n-gram models, of target text (documents labelled good) and of all text, give each document its importance
weight: the ratio of its probabilities under both. Documents are drawn without replacement in proportion to their
weights by Gumbel top-k: noise from a seeded hash is added to the log weight, and the k largest stay.

A text is three rows of n-grams: runs of three bytes; words and pairs of words; and runs of three words by their forms
(which kinds of characters, how long, whether a word repeats the one before). The log ratios of each row are averaged
over its n-grams, and the averages are added up. So a weight does not grow with a text's length, as the plain product
over all n-grams would; that one differs between documents by far more than the noise and leaves the draw nothing to
decide. SHARPNESS sets how much a difference of averages counts against the noise.

Raw counts are taken over all documents. Labels are read from a bounded sample (SAMPLE rows of smallest hash): half of it
gives the target counts, the other half says where, between good and bad documents, the weights are best cut. The budget
k is a share of the documents, or, where none is given, as many as lie above that cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.hashing import chunks, hashes_of, mix, word_spans
from tarn.llm.skew import least_hashed
from tarn.sources import scratch

ROWS, BUCKETS = 3, 1 << 16
SAMPLE = 20_000
SEED = 17
#: The share of the documents that the registered query draws.
BUDGET = 0.5
SHARPNESS = 8.0
#: Occurrences, expected and seen, that are added to a bucket's: what the sample says little about gets a ratio near one.
PRIOR = 2.0
#: N-grams without weight that are added to a row's: few n-grams say little.
FEW = 8
#: The cut keeps at least this share of the good documents on trial.
KEEP = 0.99
_SHIFT, _U = np.uint64(48), np.uint64
#: Kinds of bytes: A-Z, a-z and whatever is beyond ASCII, digits, other marks.
_KIND = np.zeros(256, "uint8")
_KIND[33:127] = 8
_KIND[48:58] = 4
_KIND[65:91] = 1
_KIND[97:123] = _KIND[128:] = 2


def _forms(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, again: np.ndarray) -> np.ndarray:
    """A number for each word's form, of 10 bits."""
    if not len(starts):
        return np.zeros(0, "uint64")
    kinds = np.bitwise_or.reduceat(_KIND[data], starts).astype("uint64")
    length = np.minimum(np.log2(stops - starts), 7).astype("uint64")
    return kinds | _U(16) * (_KIND[data[starts]] == 1) | _U(32) * again | _U(64) * length


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams (those of each row of n-grams apart), and the text that each belongs to."""
    data, starts, stops, places = word_spans(texts)
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), "int64")
    texts_of = np.arange(len(texts), dtype="int32")
    of_byte, of_word = np.repeat(texts_of, lengths), np.repeat(texts_of, np.diff(places))
    words = hashes_of(data, starts, stops)
    paired = of_word[1:] == of_word[:-1]
    forms = _forms(data, starts, stops, np.append(False, (words[1:] == words[:-1]) & paired)[: len(words)])
    rows = []
    for row, (units, bits) in enumerate(((data.astype("uint64"), 8), (words, 0), (forms, 10))):
        of = of_word if row else of_byte
        if row == 1:
            rows += [(words, of, 1), (mix(words[:-1] * _U(31) + words[1:])[paired], of[1:][paired], 1)]
        elif len(units) >= 3:
            inside = of[2:] == of[:-2]
            run = units[:-2] << _U(2 * bits) | units[1:-1] << _U(bits) | units[2:]
            rows.append((mix(run[inside] + _U(77 + row)), of[2:][inside], row))
    found = [(hashes >> _SHIFT).astype("int64") + row * BUCKETS for hashes, _, row in rows]
    return np.concatenate([np.zeros(0, "int64"), *found]), np.concatenate([np.zeros(0, "int32"), *(of for _, of, _ in rows)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition: at most one row for each bucket."""
    raw, target = np.zeros(ROWS * BUCKETS, "int64"), np.zeros(ROWS * BUCKETS, "int64")
    for batch in batches:
        for part in chunks(batch, 0):
            found, of = grams(part.column(0))
            raw += np.bincount(found, minlength=ROWS * BUCKETS)
            wanted = np.asarray(pc.fill_null(part.column(1), False), bool)
            if wanted.any():
                target += np.bincount(found[wanted[of]], minlength=ROWS * BUCKETS)
    full = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(raw[full]), pa.array(target[full])], names=["bucket", "raw", "target"])


def labelled(labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", quality: str = "quality") -> DataFrame:
    """At most sample rows (label_id, good, fits): one for each labelled doc_id, those of smallest hash."""
    rows = labels.where(F.col(doc_id).isNotNull() & F.col(quality).isNotNull())
    rows = rows.groupBy(F.col(doc_id).cast("long").alias("label_id")).agg((F.min(quality) > 0).alias("good"))
    rows = least_hashed(rows.withColumn("hash", F.xxhash64("label_id")), ["hash", "label_id"], sample, rows.count()).drop("hash")
    return rows.withColumn("fits", F.pmod(F.xxhash64("label_id", F.lit(SEED)), F.lit(2)) == 0)


def ratio(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log of target over raw probability for each bucket, the target smoothed by the raw model; docs has doc_id and text."""
    wanted = F.coalesce(F.col("good") & F.col("fits"), F.lit(False)).alias("target")
    rows = docs.join(F.broadcast(labels), docs["doc_id"] == labels["label_id"], "left").select("text", wanted)
    counts = rows.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(ROWS * BUCKETS), np.zeros(ROWS * BUCKETS)
    held = counts.toPandas()  # at most ROWS * BUCKETS rows
    raw[held["bucket"]] = held["raw"]
    target[held["bucket"]] = held["target"]
    return log_ratio(raw, target)


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of both models of each row of n-grams. The target's is the raw one times (seen + PRIOR) / (expected + PRIOR)."""
    out = np.zeros(len(raw))
    for row in range(ROWS):
        at = slice(row * BUCKETS, (row + 1) * BUCKETS)
        if raw[at].sum():
            share = raw[at] / raw[at].sum()
            times = (target[at] + PRIOR) / (target[at].sum() * share + PRIOR)
            out[at] = np.log(times) - np.log((share * times).sum())
    return out


def log_weights(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    found, of = grams(texts)
    cell = of.astype("int64") * ROWS + found // BUCKETS
    sums = np.bincount(cell, weights=table[found], minlength=len(texts) * ROWS)
    many = np.bincount(cell, minlength=len(texts) * ROWS)
    return SHARPNESS * (sums / (many + FEW)).reshape(-1, ROWS).sum(1)


def weigher(table: np.ndarray):
    """A column function: the log importance weight of a text."""

    def weigh(texts: pa.Array) -> pa.Array:
        out = []
        for part in chunks(pa.RecordBatch.from_arrays([texts], names=["text"]), 0):
            out.append(log_weights(part.column(0), table))
        return pa.array(np.concatenate([np.zeros(0), *out]), pa.float64())

    return F.arrow_udf(weigh, "double")


def gumbel(seed: int, *columns: str) -> Column:
    """Standard Gumbel noise from a hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut that keeps most of good (KEEP at least) and rejects most of bad, as shares; ties: the middle one."""
    if not len(bad):
        return -np.inf
    if not len(good):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    middles = np.concatenate([[at[0] - 1], (at[1:] + at[:-1]) / 2])
    kept = 1 - np.searchsorted(np.sort(good), middles) / len(good)
    rejected = np.searchsorted(np.sort(bad), middles) / len(bad)
    score = np.where(kept >= KEEP, kept + rejected, -1)
    return float(middles[int(np.flatnonzero(score == score.max()).mean())])


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 1_024, few: int = 10_000) -> float:
    """Exactly, by counting in ever narrower ranges; no more than few values come to the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    while True:
        inside = df.where(F.col(column).between(low, high))
        above = df.where(F.col(column) > high).count()
        if low == high or inside.count() <= few:
            values = [low] if low == high else sorted((r[0] for r in inside.select(column).collect()), reverse=True)
            return values[min(max(k - above - 1, 0), len(values) - 1)]
        width = (high - low) / bins
        slot = F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("slot")
        counts = inside.groupBy(slot).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).orderBy(F.desc("slot")).collect()
        for row in counts:
            above += row["n"]
            if above >= k:
                break
        low, high = row["low"], row["high"]


def _scored(docs: DataFrame, labels: DataFrame, seed: int, budget: float | None, doc_id: str, text: str, whole: bool) -> tuple[DataFrame, float]:
    """doc_id, log_weight, key and (whole) the row itself of each document, and the least key that stays."""
    row = [F.struct("*").alias("_row")] if whole else []
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), *row)
    known = labelled(labels)
    weigh = weigher(ratio(rows, known))
    scored = rows.join(F.broadcast(known), rows["doc_id"] == known["label_id"], "left")
    scored = scored.select("doc_id", weigh("text").alias("log_weight"), gumbel(seed, "doc_id", "text").alias("noise"), "label_id", "good", "fits", *(["_row"] if whole else []))
    scored = scratch(scored.withColumn("key", F.col("log_weight") + F.col("noise")).drop("noise"), "weights")
    if budget is None:
        trial = scored.where("good is not null and not fits").groupBy("label_id", "good").agg(F.min("log_weight").alias("log_weight"))
        trial = trial.select("good", "log_weight").toPandas()  # a row for each label, SAMPLE at most
        cut = best_cut(trial["log_weight"][trial["good"]].to_numpy(), trial["log_weight"][~trial["good"].astype(bool)].to_numpy())
        k = scored.where(F.col("log_weight") >= cut).count()
    else:
        k = int(scored.count() * budget)
    return scored, float(kth_largest(scored, "key", k) if k else np.inf)


def classify(docs: DataFrame, labels: DataFrame, seed: int = SEED, budget: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, log_weight, key and kept for every document.

    budget: the share of the documents to draw; None: as many as the labels on trial call good. Defined cases: a null
    text, or one under three bytes and without words, has weight one (log 0); repeated rows get equal keys and stay or go
    together; keys equal to the limit all stay, even beyond k; a null doc_id is never labelled; without labels of both
    kinds and without a budget all documents stay; other columns are ignored; an empty table gives no rows.
    """
    scored, limit = _scored(docs, labels, seed, budget, doc_id, text, whole=False)
    return scored.select("doc_id", "log_weight", "key", (F.col("key") >= limit).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = SEED, budget: float | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns. They are written once beside their keys, so no text is weighed twice."""
    scored, limit = _scored(docs, labels, seed, budget, doc_id, text, whole=True)
    return scored.where(F.col("key") >= limit).select("_row.*")
