import heapq
import random
import zlib

from tarn.llm.sharding import schedule, shard_documents


def by_the_book(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    counts = {}
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
        counts[size, s] = counts.get((size, s), 0) + 1
    return counts


def test_schedule_is_that_of_the_heap():
    rng = random.Random(1)
    for _ in range(60):
        shards = rng.randint(1, 7)
        sizes = [rng.choice([16, 17, 20, 33, 500, rng.randint(16, 90)]) for _ in range(rng.randint(0, 400))]
        got = {}
        for size, starts, owners in schedule([(s, sizes.count(s)) for s in sorted(set(sizes), reverse=True)], shards):
            for a, b, s in zip(starts, [*starts[1:], sizes.count(size)], owners, strict=True):
                got[size, s] = b - a
        assert got == by_the_book(sizes, shards)


def check(rows, texts, shards):
    assert len(rows) == len(texts)
    for r, t in zip(sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"])), texts, strict=False):
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    by_text, by_shard = {}, {}
    for r in rows:
        by_text.setdefault(r["group_key"], set()).add(r["shard"])
        by_shard.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())


def test_odd_documents(odd):
    rows = shard_documents(odd, 3).collect()
    check(rows, [r["text"] for r in odd.collect()], 3)
    by_id = {r["doc_id"]: r for r in rows}
    assert (by_id[0]["size"], by_id[0]["text_crc32"]) == (16, 0) and by_id[0]["shard"] == by_id[1]["shard"]
    assert by_id[7]["size"] == 16 + len("é ü 😀 　 \x00  x".encode()) and by_id[7]["text_crc32"] == zlib.crc32("é ü 😀 　 \x00  x".encode())
    assert sum(r["doc_id"] == 4 for r in rows) == 2


def test_balance_and_hot_group(docs):
    texts = ["same text"] * 300 + [f"document {i} " + "y" * (i % 50) for i in range(600)]
    rows = shard_documents(docs(texts), 4).collect()
    check(rows, texts, 4)
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(4)]
    assert max(loads) - min(loads) < 200


def test_empty(docs):
    assert shard_documents(docs([]), 5).collect() == []


def test_the_frame_is_that_of_the_heap(docs, monkeypatch):
    """Groups of one size are interchangeable; how many of each size a shard has is the heap's."""
    monkeypatch.setattr("tarn.llm.sharding.PLANNED", 3)
    monkeypatch.setattr("tarn.llm.skew.FLOOR", 5)
    rng = random.Random(6)
    texts = ["same" for _ in range(120)] + [rng.choice("abcd") * rng.randint(1, 40) for _ in range(300)] + [f"{i:04}" for i in range(150)] + [None, "", "é" * 30]
    rows = shard_documents(docs(texts), 7).collect()
    sizes = {}
    for t in texts:
        sizes[t or ""] = sizes.get(t or "", 0) + len((t or "").encode()) + 16
    got = {}
    for key in {(r["group_key"], r["group_size"], r["shard"]) for r in rows}:
        got[key[1:]] = got.get(key[1:], 0) + 1
    assert got == by_the_book(list(sizes.values()), 7)
    check(rows, texts, 7)
