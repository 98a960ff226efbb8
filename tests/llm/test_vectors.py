import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import ann, hamming
from tarn.llm.ann import nearest_vectors
from tarn.llm.hamming import Table, nearest_codes, sign_codes

NAN, INF = float("nan"), float("inf")


def clusters(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, d))
    return (centres[rng.integers(0, 12, n)] + 0.4 * rng.normal(size=(n, d))).astype("float32")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, label int, code string")


def cosines(a, b):
    a, b = np.asarray(a, "float64"), np.asarray(b, "float64")
    return float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)))


@pytest.fixture
def odd(spark):
    good = [(i, [float(x) for x in v]) for i, v in enumerate(clusters(40, 4))]
    bad = [(100, None), (101, [0.0] * 4), (102, [1.0, None, 1.0, 1.0]), (103, [NAN, 1.0, 1.0, 1.0]), (104, [INF, 1.0, 1.0, 1.0]), (105, [1.0, 2.0]), (106, []), (None, [1.0, 1.0, 1.0, 1.0])]
    same = [(200 + i, good[0][1]) for i in range(9)] + [(3, good[3][1])]
    return table(spark, good + bad + same), dict(good + same)


def test_nearest_vectors_of_odd_rows(odd):
    frame, good = odd
    rows = nearest_vectors(frame, F.col("vec_id") % 50 == 0, 5).collect()
    for q in (0, 200):
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        want = sorted(((-cosines(good[q], v), k) for k, v in good.items() if k != q))[:5]
        assert [r["vec_id"] for r in own] == [k for _, k in want] and [r["rank"] for r in own] == [1, 2, 3, 4, 5]
        assert np.allclose([r["score"] for r in own], [-s for s, _ in want], atol=1e-15)
    assert {r["query_id"] for r in rows} == {0, 200}


def test_recall_on_many_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 700)
    monkeypatch.setattr(ann, "TEAM", 30)
    v = clusters(6000)
    rows = nearest_vectors(table(spark, [(i, [float(x) for x in r]) for i, r in enumerate(v)]), F.col("vec_id") % 50 == 0, 5).collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 6000, 50):
        s = unit @ unit[q]
        s[q] = -2
        want = set(np.argsort(-s)[:5].tolist())
        own = [r["vec_id"] for r in rows if r["query_id"] == q]
        assert len(own) == 5
        hits += len(want & set(own))
    assert hits / (120 * 5) >= 0.9


@pytest.mark.parametrize("noise", [0.01, 0.05])
def test_neighbours_in_a_crowd_of_near_copies(spark, noise):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1800, 64))
    v[:600] = v[0] + noise * rng.normal(size=(600, 64))
    v = v.astype("float32")
    rows = nearest_vectors(table(spark, [(i, [float(x) for x in r]) for i, r in enumerate(v)]), F.col("vec_id") % 20 == 0, 5).collect()
    wide = v.astype("float64")
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    for q in range(0, 600, 20):
        s = unit @ unit[q]
        s[q] = -2
        own = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["vec_id"] for r in own] == np.argsort(-s)[:5].tolist()


def test_few_candidates(spark):
    two = table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])])
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in nearest_vectors(two, F.col("vec_id") % 50 == 0, 5).collect()] == [(0, 1, 0.0)]
    assert nearest_vectors(table(spark, []), F.col("vec_id") % 50 == 0, 5).collect() == []


def test_long_lists_are_dealt_over_cells():
    n = ann.CELL
    cells = ann.pack({0: 5, 1: 2 * n + 1, 2: n - 1, 3: 2, 4: n})
    assert cells[1][1] == 3
    spans = sorted((first, first + parts) for first, parts in set(cells.values()))
    assert cells[0] == (0, 1) and spans[-1][1] <= 7


def brute(codes, q, k):
    rows = sorted((bin((c ^ codes[q]) & (1 << 64) - 1).count("1"), i) for i, c in codes.items() if i != q)[:k]
    return [(i, d) for d, i in rows]


def test_nearest_codes_are_exact(spark, monkeypatch):
    monkeypatch.setattr(hamming, "ENTRIES", 300)
    monkeypatch.setattr(hamming, "QUERIES", 4)
    rng = np.random.default_rng(3)
    base = rng.integers(-(1 << 62), 1 << 62, 900)
    near = base[:100] ^ (1 << rng.integers(0, 62, 100))
    every = [int(x) for x in np.concatenate([base, near, np.repeat(base[:1], 60)])]
    codes = dict(enumerate(every))
    frame = spark.createDataFrame([*codes.items(), (5, every[5]), (None, 3), (7000, None)], "vec_id long, code long")
    rows = nearest_codes(frame, F.col("vec_id") % 100 == 0, 10).collect()
    for q in range(0, len(codes), 100):
        own = sorted((r["rank"], r["vec_id"], r["distance"]) for r in rows if r["query_id"] == q)
        assert [(i, d) for _, i, d in own] == brute(codes, q, 10)


def test_a_radius_finds_all_that_it_covers():
    rng = np.random.default_rng(5)
    codes = np.unique(np.concatenate([rng.integers(0, 1 << 63, 2000).astype("uint64"), np.uint64(12345) ^ (np.uint64(1) << rng.integers(0, 63, 40).astype("uint64")) ^ (np.uint64(1) << rng.integers(0, 63, 40).astype("uint64"))]))
    ids = np.arange(len(codes))
    for query in (12345, int(codes[7]), int(rng.integers(0, 1 << 63))):
        true = np.bitwise_count(codes ^ np.uint64(query))
        for radii in ((0, 1), (0, 1, 2), (0, 1, 2, 3, 4, 5, 6, 7)):
            found = set()
            for segment in range(hamming.SEGMENTS):
                table = Table(codes, ids, np.ones(len(codes), "int64"), segment)
                places = table.within(query, radii)
                assert len(set(places.tolist())) == len(places)
                found |= set(table.codes[places].tolist())
            assert set(codes[true <= 4 * (radii[-1] + 1) - 1].tolist()) <= found
        places, distance = table.nearest(query, ids, 5, 64)
        assert distance.tolist() == np.sort(true)[:5].tolist()


@pytest.mark.parametrize("rounds", [((0, 1), (2,), (3,)), ((0,),)])
def test_ids_with_several_codes(spark, monkeypatch, rounds):
    """Every other id has several codes, near ones among them; some codes have many ids."""
    monkeypatch.setattr(hamming, "ENTRIES", 50)
    monkeypatch.setattr(hamming, "ROUNDS", rounds)
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 62), 1 << 62, 12)
    rows = {(i, int(base[i % 12] ^ (1 << int(rng.integers(0, 62))))) for i in range(120)}
    rows |= {(7, int(base[3] ^ (1 << j))) for j in range(40)} | {(i, int(base[5])) for i in range(30)} | {(i % 4, int(base[0] ^ (3 << j))) for i in range(4) for j in range(20)}
    got = nearest_codes(spark.createDataFrame([*rows, *rows], "vec_id long, code long"), F.col("vec_id") % 20 == 0, 10).collect()
    for q in range(0, 120, 20):
        least = {}
        for own in (c for i, c in rows if i == q):
            for i, c in rows:
                if i != q:
                    least[i] = min(least.get(i, 99), bin((c ^ own) & (1 << 64) - 1).count("1"))
        want = sorted((d, i) for i, d in least.items())[:10]
        assert [(r["distance"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want


def test_vectors_of_ids_with_several(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(25)] + [(3, (np.array([1, 1, 1, 1]) + 0.01 * rng.normal(size=4)).tolist()) for _ in range(40)] + [(0, [1.0, 1.0, 1.0, 1.0])]
    rows = [(i, np.asarray(v, "float32").tolist()) for i, v in rows]
    got = nearest_vectors(table(spark, rows), F.col("vec_id") % 50 == 0, 5).collect()
    top = {}
    for own in (v for i, v in rows if i == 0):
        for i, v in rows:
            if i:
                top[i] = max(top.get(i, -2), cosines(own, v))
    want = sorted((-s, i) for i, s in top.items())[:5]
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [i for _, i in want]


def test_huge_and_tiny_components(spark):
    rows = [(0, [1e200, 2e200]), (1, [2e200, 4e200]), (2, [1e-200, -1e-200]), (3, [1e200, 1e-200]), (4, [3.0, 6.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(nearest_vectors(frame, F.col("vec_id") == 0, 5).collect(), key=lambda r: r["rank"])
    assert [r["vec_id"] for r in got] == [1, 4, 3, 2] and np.allclose([r["score"] for r in got], [1, 1, 1 / 5**0.5, -1 / 10**0.5], atol=1e-15)


def test_each_length_is_searched_by_itself(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clusters(30, 4))] + [(50 + i, [float(x) for x in v]) for i, v in enumerate(clusters(8, 6, 1))]
    found = nearest_vectors(table(spark, rows), F.col("vec_id") % 50 == 0, 40).collect()
    assert {r["vec_id"] for r in found if r["query_id"] == 0} == set(range(1, 30)) and {r["vec_id"] for r in found if r["query_id"] == 50} == set(range(51, 58))
    near = nearest_codes(sign_codes(table(spark, rows)), F.col("vec_id") % 50 == 0, 40).collect()
    assert {r["vec_id"] for r in near if r["query_id"] == 50} == set(range(51, 58))


def test_cells_meet_their_neighbours_only(spark, monkeypatch):
    """The rows that are copied for teams do not grow with queries times entries."""
    monkeypatch.setattr(ann, "CELL", 64)
    monkeypatch.setattr(ann, "SAMPLE", 2_000)
    moved = []
    for n in (1_000, 4_000):
        v = clusters(n, 16, 3)
        real = ann.scratch
        seen = {}
        monkeypatch.setattr(ann, "scratch", lambda df, name, real=real, seen=seen: seen.setdefault(name, real(df, name)))
        nearest_vectors(table(spark, [(i, [float(x) for x in r]) for i, r in enumerate(v)]), F.col("vec_id") % 50 == 0, 5).count()
        monkeypatch.setattr(ann, "scratch", real)
        moved.append(seen["vector-routes"].select("home", "cell").distinct().count() * 64)
    assert moved[1] < 4 * 2.5 * moved[0]


def test_sign_codes(spark, odd):
    frame, good = odd
    got = {(r["vec_id"], r["code"]) for r in sign_codes(frame).where("dims = 4").collect()}
    assert got == {(k, sum(1 << i for i, x in enumerate(v) if x > 0)) for k, v in good.items()}
    wide = table(spark, [(1, [1.0] * 64), (2, [-1.0] * 63 + [1.0])])
    assert {(r["vec_id"], r["code"]) for r in sign_codes(wide).collect()} == {(1, -1), (2, -(1 << 63))}
    assert nearest_codes(sign_codes(table(spark, [])), F.col("vec_id") >= 0, 3).collect() == []


def test_sign_codes_of_wide_vectors_are_refused(spark):
    with pytest.raises(Exception, match="65 components do not fit a code of 64 bits"):
        sign_codes(table(spark, [(1, [1.0] * 65), (2, [-1.0] * 65)])).collect()
