import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.llm import quality
from tarn.llm.quality import BUCKETS, PRIOR, best_cut, classify, grams, keep_good, kth_largest


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(60)]
    texts, good = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        good.append(i % 4 > 0)
        if i % 4 == 0:
            t = [w.upper() + "$$$" for w in t] if i % 8 else [t[0]] * len(t)
        texts.append(" ".join(t))
    return texts, good


@pytest.fixture
def labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, text string")

    return make


def test_held_out_accuracy(docs, labels):
    texts, good = corpus(2400)
    known = labels([(i, int(g), 0, "x") for i, g in enumerate(good) if i % 2 == 0 or i % 8 == 1][:1300] + [(4, 0, 0, None), (None, 1, 0, None), (8, None, 0, None)])
    rows = {r["doc_id"]: r for r in classify(docs(texts), known).collect()}
    assert len(rows) == 2400
    assert np.mean([rows[i]["kept"] == g for i, g in enumerate(good)]) > 0.98
    assert np.mean([rows[i]["kept"] for i, g in enumerate(good) if g]) > 0.99
    kept = keep_good(docs(texts), known)
    assert kept.columns == docs([]).columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["kept"]}


def by_the_book(text):
    """N-grams of each row as Python values."""
    data = (text or "").encode()
    words = [w for w in re.split(rb"[ \t\n\x0b\f\r]+", data) if w]
    low = [w.translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for w in words]
    kinds = lambda w: tuple(sorted({"A" if 65 <= c <= 90 else "a" if 97 <= c <= 122 or c > 127 else "0" if 48 <= c <= 57 else "." if 33 <= c < 127 else "" for c in w} - {""}))
    forms = [(kinds(w), 65 <= w[0] <= 90, i > 0 and low[i] == low[i - 1], min(7, len(w).bit_length() - 1)) for i, w in enumerate(words)]
    return [[data[i : i + 3] for i in range(len(data) - 2)], [(w,) for w in low] + list(zip(low, low[1:], strict=False)), list(zip(forms, forms[1:], forms[2:], strict=False))]


TEXTS = ["abcd", None, "ab", "a a A b", "é", "x x  x", "Und Und Und. 3,5 THE!! the", "", "\n", "a" * 300 + " b b"]


def test_grams_by_the_book():
    found, of = grams(pa.array(TEXTS))
    seen = collections.defaultdict(set)
    for i, t in enumerate(TEXTS):
        own = found[of == i]
        for row, want in enumerate(by_the_book(t)):
            here = own[own // BUCKETS == row].tolist()
            assert len(here) == len(want), (t, row)
            if row != 1:
                for bucket, gram in zip(here, want, strict=True):
                    seen[row, gram].add(bucket)
    # equal n-grams share a bucket, different ones (so few of them) do not
    assert all(len(b) == 1 for b in seen.values()) and len({next(iter(b)) for b in seen.values()}) == len(seen)
    assert found.min() >= 0 and found.max() < quality.ROWS * BUCKETS


def test_weights_are_the_ratio_of_both_models(docs, labels):
    texts, good = corpus(60)
    known = labels([(i, int(g), 0, "x") for i, g in enumerate(good)])
    fits = {r["label_id"] for r in quality.labelled(known).where("good and fits").collect()}
    buckets = [grams(pa.array([t]))[0].tolist() for t in texts]
    counts = [[collections.Counter(b for b in own if b // BUCKETS == row) for row in range(3)] for own in buckets]
    raw = [sum((c[row] for c in counts), collections.Counter()) for row in range(3)]
    target = [sum((c[row] for i, c in enumerate(counts) if i in fits), collections.Counter()) for row in range(3)]
    want = []
    for c in counts:
        weight = 0
        for row in range(3):
            n, m = sum(raw[row].values()), sum(target[row].values())
            times = {g: (target[row][g] + PRIOR) / (m * raw[row][g] / n + PRIOR) for g in raw[row]}
            whole = sum(raw[row][g] / n * times[g] for g in raw[row])
            weight += sum(k * np.log(times[g] / whole) for g, k in c[row].items()) / (sum(c[row].values()) + quality.FEW)
        want.append(quality.SHARPNESS * weight)
    got = {r["doc_id"]: r["log_weight"] for r in classify(docs(texts), known).collect()}
    assert np.abs(np.array([got[i] for i in range(60)]) - want).max() < 1e-6


def test_the_draw_is_gumbel_top_k(docs, labels):
    texts, good = corpus(400)
    known = labels([(i, int(g), 0, "x") for i, g in enumerate(good)])
    draws = {}
    for seed in (1, 2, 3):
        rows = sorted(classify(docs(texts), known, seed, budget=0.25).collect(), key=lambda r: r["doc_id"])
        keys = np.array([r["key"] for r in rows])
        # brute force: the hundred largest keys
        assert {r["doc_id"] for r in rows if r["kept"]} == set(np.argsort(-keys)[:100].tolist())
        draws[seed] = {r["doc_id"] for r in rows if r["kept"]}
        kept = keep_good(docs(texts), known, seed, budget=0.25)
        assert {r["doc_id"] for r in kept.collect()} == draws[seed]
    assert all(20 < len(draws[a] & draws[b]) < 80 for a, b in ((1, 2), (2, 3), (1, 3)))


def test_more_weight_is_drawn_more_often(spark):
    weights = np.repeat([-30.0, -3.0, -1.0, 0.0, 1.0, 2.0], 40)
    n, k, seeds = len(weights), 60, 150
    frame = spark.createDataFrame([(i, float(w)) for i, w in enumerate(weights)], "doc_id long, w double")
    keys = frame.select("doc_id", *[(F.col("w") + quality.gumbel(s, "doc_id")).alias(f"k{s}") for s in range(seeds)]).orderBy("doc_id").toPandas().to_numpy()[:, 1:]
    noise = (keys - weights[:, None]).ravel()
    uniform = np.sort(np.exp(-np.exp(-noise)))
    assert np.abs(uniform - (np.arange(len(uniform)) + 0.5) / len(uniform)).max() < 0.02
    ours = (np.argsort(np.argsort(-keys, axis=0), axis=0) < k).mean(1).reshape(6, 40).mean(1)
    rng = np.random.default_rng(0)
    theirs = np.zeros(n)
    for _ in range(2000):  # one after another in proportion to the weights left, which Gumbel top-k amounts to
        theirs[rng.choice(n, k, replace=False, p=np.exp(weights) / np.exp(weights).sum())] += 1 / 2000
    theirs = theirs.reshape(6, 40).mean(1)
    assert ours[0] == 0 and np.all(np.diff(ours) > 0) and np.abs(ours - theirs).max() < 0.03


def test_odd_documents(odd, labels):
    rows = classify(odd, labels([(4, 1, 0, None), (8, 0, 0, None)])).collect()
    assert len(rows) == odd.count()
    assert all(r["log_weight"] == 0 for r in rows if r["doc_id"] in (0, 1))
    assert len({r["kept"] for r in rows if r["doc_id"] == 4}) == 1
    # no labels: nothing is rejected
    assert all(r["kept"] for r in classify(odd, labels([])).collect())
    assert keep_good(odd, labels([])).count() == odd.count()


def test_empty(docs, labels):
    assert classify(docs([]), labels([(1, 1, 0, None)])).collect() == [] and keep_good(docs([]), labels([])).collect() == []


def test_cut():
    assert best_cut(np.array([1.0, 2.0]), np.array([-3.0, -1.0])) == 0
    assert best_cut(np.array([1.0]), np.array([])) == -np.inf
    cut = best_cut(np.arange(100.0), np.array([-5.0, 50.5]))
    assert -5 < cut < 1


def test_kth_largest(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5, rng.gauss(0, 1e6)]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 2, 250, 500):
        assert kth_largest(df, "v", k, bins=7, few=3) == sorted(values, reverse=True)[k - 1]
