import random

import numpy as np
import pyarrow as pa
import pytest

from tarn.llm import minhash
from tarn.llm.components import components
from tarn.llm.hashing import distinct, shingle_hashes, word_hashes
from tarn.llm.minhash import near_duplicates, one_each

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"


def shingles(text):
    words = (text or "").encode().translate(LOWER)
    for b in BLANK[1:]:
        words = words.replace(bytes([b]), b" ")
    words = [w for w in words.split(b" ") if w]
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        least = key if not sets[i] else min(ids, default=None)
        out.append((key, len(sets[i]), least, key == least))
    return out


def got(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def corpus(n, seed=4):
    """Unrelated texts, families of edited copies, and short texts around a common passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(30)]
    bases = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for i in range(n):
        kind = i % 4
        if kind == 0:
            t = [word() for _ in range(rng.randint(1, 60))]
        elif kind == 1:
            t = [word() for _ in range(rng.randint(5, 25))] + passage
        else:
            t = list(rng.choice(bases))
            for _ in range(rng.randint(0, 6)):
                t[rng.randrange(len(t))] = word()
        texts.append(" ".join(t).title() if rng.random() < 0.3 else "  ".join(t))
    return list(enumerate(texts))


def test_hashes_tell_words_and_shingles_apart():
    texts = [t for _, t in corpus(60)] + [None, "", " ", "A b", "a b", "é É", "a b c d", "a b c d e f"]
    words, places = word_hashes(pa.array(texts))
    values, offsets = distinct(*shingle_hashes(words, places))
    seen = {}
    for k, t in enumerate(texts):
        assert offsets[k + 1] - offsets[k] == len(shingles(t))
        seen.setdefault(frozenset(shingles(t)), set()).add(values[offsets[k] : offsets[k + 1]].tobytes())
    assert all(len(v) == 1 for v in seen.values()) and len({x for v in seen.values() for x in v}) == len(seen)


def test_both_permutations_are_bijections():
    x = (np.arange(1 << 18, dtype="uint64") * 16_411 % (1 << 32)).astype("uint32")
    assert len(np.unique(minhash.scatter(x))) == len(np.unique(x)) == len(np.unique(minhash.ordering(x.copy())))


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 4000).astype("uint64")
    b = np.concatenate([a[:3000], rng.integers(0, 1 << 63, 1000).astype("uint64")])
    s = minhash.signatures(np.concatenate([a, b]), np.array([0, 4000, 8000]))
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.15


@pytest.mark.parametrize("block", [256, 5])
def test_groups_are_those_of_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus(160)
    assert got(near_duplicates(docs(rows))) == sorted(brute(rows), key=str)


def test_odd_documents(odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert got(near_duplicates(odd)) == sorted(brute(rows), key=str)


def test_one_row_of_each_group_stays(docs, odd):
    kept = one_each(odd)
    assert kept.columns == odd.columns
    rows = sorted(((r["doc_id"], (r["text"] or "")[:30]) for r in kept.collect()), key=str)
    # 5, 6 are copies of 4; 4 itself is there twice; null, empty and blank texts are all different rows without words
    assert [k for k, _ in rows if k in (4, 5, 6)] == [4]
    assert len(rows) == 12
    exact = docs([(3, "a b c d e f"), (3, "a b c d e f"), (9, "A B C D E F"), (None, "p q r s t u"), (None, "p q r s t u")])
    assert sorted(((r["doc_id"], r["text"]) for r in one_each(exact).collect()), key=str) == [(3, "a b c d e f"), (None, "p q r s t u")]


def test_large_groups_of_copies_and_near_copies(docs):
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(base)) for i in range(200)]
    rows += [(200 + i, " ".join([*base[:40], f"x{i}", *base[41:]])) for i in range(200)]
    out = near_duplicates(docs(rows)).collect()
    assert {r["component_id"] for r in out} == {0} and sum(r["kept"] for r in out) == 1


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    group = {x: x for e in edges for x in e}
    for _ in group:
        for a, b in edges:
            group[a] = group[b] = min(group[a], group[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: group[x] for x in linked}


def test_empty(docs):
    assert near_duplicates(docs([])).collect() == [] and one_each(docs([])).collect() == []
