import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarn.llm import mixing
from tarn.llm.mixing import Mix, mix_documents


def waterline(children, budget):
    """children: name -> (weight, capacity); fills them step by step."""
    alloc = {n: 0 for n in children}
    open_ = {n for n, (w, c) in children.items() if w > 0 and c > 0}
    left = budget
    while open_:
        total = sum(children[n][0] for n in open_)
        full = {n for n in open_ if children[n][1] * total <= children[n][0] * left}
        if not full:
            break
        least = min(children[n][1] / children[n][0] for n in full)
        for n in [n for n in full if children[n][1] / children[n][0] == least]:
            alloc[n] = children[n][1]
            left -= children[n][1]
            open_.discard(n)
    if open_:
        total = sum(children[n][0] for n in open_)
        for n in open_:
            alloc[n] = children[n][0] * left // total
        spare = left - sum(alloc[n] for n in open_)
        for n in sorted(open_)[:spare]:
            alloc[n] += 1
    return alloc


def brute(rows, weights, share, epochs, seed):
    """rows: (doc_id, (level values), tokens) -> copies by row, and budgets by leaf."""
    levels = ["domain", "lang", "source"]
    supply = {}
    for _, leaf, n in rows:
        supply[leaf] = supply.get(leaf, 0) + n
    weight = lambda depth, value: weights.get(levels[depth], {}).get(value, 1)
    cap = {leaf: t * epochs if all(weight(d, v) > 0 for d, v in enumerate(leaf)) else 0 for leaf, t in supply.items()}
    budgets = {(): int(sum(supply.values()) * share)}
    for depth in range(3):
        for parent in {leaf[:depth] for leaf in supply}:
            names = {leaf[depth] for leaf in supply if leaf[:depth] == parent}
            children = {n: (weight(depth, n), sum(c for leaf, c in cap.items() if leaf[: depth + 1] == (*parent, n))) for n in names}
            for n, a in waterline(children, budgets[parent]).items():
                budgets[(*parent, n)] = a
    copies = []
    for key, leaf, n in rows:
        total, budget = supply[leaf], budgets[leaf]
        whole, part = (budget // total, budget % total) if total else (0, 0)
        order = lambda k, m, w=whole: hashlib.md5(f"{seed}:{w + 1}:{'' if k is None else k}:{m}".encode()).hexdigest()
        upto = sum(m for k, other, m in rows if other == leaf and order(k, m) <= order(key, n))
        copies.append(whole + int(part > 0 and (n == 0 or upto <= part)))
    return copies, budgets


@pytest.mark.parametrize("share,epochs", [(0.6, 4), (0.9, 1), (3.0, 2), (0.05, 1)])
def test_budgets_and_copies_are_those_of_brute_force(spark, share, epochs):
    rng = random.Random(7)
    data = [(i, " ".join("w" * rng.randint(0, 30)) or None, rng.choice(["en", "en", "de", None]), rng.choice(["src0"] * 6 + ["src1", "src2", "src6", "src9", "odd", None])) for i in range(300)] + [(None, "a b", "en", "src0"), (5, "a b c", "en", "src0"), (5, "a b c", "en", "src0")]
    frame = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    weights = {"domain": {"web": 4, "reference": 3, "forum": 0, "books": 2}, "lang": {"en": 6, "de": 2}}
    got = mix_documents(frame, share, epochs, 29, weights).collect()
    domain = {"src0": "web", "src1": "reference", "src2": "forum", "src6": "forum", "src9": "reference"}
    rows = [(k, (domain.get(s, "(none)"), lang or "(none)", s or "(none)"), len((t or "").split())) for k, t, lang, s in data]
    copies, budgets = brute(rows, weights, share, epochs, 29)
    want = sorted((str(k), *leaf, n, c) for (k, leaf, n), c in zip(rows, copies, strict=True))
    assert sorted((str(r["doc_id"]), r["domain"], r["lang"], r["source"], r["n_tokens"], r["copies"]) for r in got) == want
    assert all(r["leaf_budget"] == budgets[r["domain"], r["lang"], r["source"]] for r in got)
    applied = Mix(frame, mixing.document_levels(), weights, share, epochs, 29).apply(frame)
    assert applied.columns == frame.columns
    assert sorted((str(r["doc_id"]), len((r["text"] or "").split())) for r in applied.collect()) == sorted((str(k), n) for (k, _, n), c in zip(rows, copies, strict=True) for _ in range(c))


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", "1", 10), ("a", "x", "2", 1000), ("a", "y", "3", 1000), ("b", "x", "4", 5), ("b", "y", "5", 1000)]
    frame = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["alloc"] for r in mixing.budgets(frame, ["domain", "lang", "source"], {}, 400, 1).collect()}
    assert got == {"1": 10, "2": 90, "3": 100, "4": 5, "5": 195}


def test_odd_documents(odd):
    rows = mix_documents(odd).collect()
    assert len(rows) == odd.count()
    taken = Mix(odd, mixing.document_levels(), {}, 1.0, 1, 3).apply(odd)
    assert taken.columns == odd.columns and taken.count() == odd.count()


def test_columns_with_dots_in_their_names(docs):
    frame = docs(["a b", "c d e", "f"]).withColumn("x.y", F.lit(1)).withColumn("a`b", F.lit(2))
    taken = Mix(frame, mixing.document_levels(), {}, 1.0, 1, 3).apply(frame)
    assert taken.columns == frame.columns and taken.count() == 3


def test_empty(docs):
    assert mix_documents(docs([])).collect() == []
    assert Mix(docs([]), mixing.document_levels(), {}, 1.0, 1, 3).apply(docs([])).collect() == []


def test_no_python_on_the_executors(docs):
    plan = mix_documents(docs(["a b c"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert F is not None


def test_words_are_runs_without_blanks(spark):
    drawn = random.Random(5)
    texts = [None, "", " ", " \t\n\x0b\x0c\r", "a", " a", "a ", "x x x", "é b c", "😀 \x1cx\x85y", "word is " * 500_000]
    texts += ["".join(drawn.choice(" \t\n\x0b\x0c\rab\x1fé 😀x") for _ in range(drawn.randrange(40))) for _ in range(200)]
    found = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", mixing.count_words(F.col("text")).alias("n"))
    blanks = str.maketrans(dict.fromkeys("\t\n\x0b\x0c\r", " "))
    assert dict(found.collect()) == {i: sum(w != "" for w in (t or "").translate(blanks).split(" ")) for i, t in enumerate(texts)}
