import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import chat
from tarn.llm.chat import ROLES, STATES, Model, format_chats, observe


def conversations(spark, n=60, long=0):
    rows = []
    for c in range(n):
        turns = 2 + c % 5 + (long if c == 7 else 0)
        for t in range(turns):
            role = "system" if t == 0 and c % 6 == 0 else ROLES[1 + (t + (c % 6 == 0)) % 2]
            rows.append((c, t, role, "\n".join(f"Line {i} of {t} in {c}{'?' if role == 'user' else '.'}" for i in range(1 + (c * 7 + t) % 4)), "extra"))
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, state string")


def whole_pass(frame):
    """Every transcript by one Viterbi pass over all its lines, with the model of the other half."""
    lines = chat.halves(chat.transcripts(frame).withColumn("symbol", observe(F.col("text"))))
    models = [chat.fit(lines.where(F.col("half") == 1 - half)) for half in (0, 1)]
    rows = lines.withColumn("tie", F.xxhash64("text")).toPandas().sort_values(["conv", "turn", "line", "tie"], kind="stable", na_position="first")
    return {k[1:]: models[v["half"].iloc[0]].path(v["symbol"].to_numpy()).tolist() for k, v in rows.groupby("conv")}


def decoded(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["number"]):
        out.setdefault("" if r["conv_id"] is None else str(r["conv_id"]), []).append(2 * ROLES.index(r["role"]) + (not r["begins"]))
    return out


@pytest.mark.parametrize("segment", [512, 5])
def test_segments_give_the_path_of_one_pass(spark, monkeypatch, segment):
    monkeypatch.setattr(chat, "SEGMENT", segment)
    frame = conversations(spark, long=150)
    monkeypatch.setattr(chat, "TOGETHER", 40)
    rows = format_chats(frame).collect()
    assert decoded(rows) == whole_pass(frame)
    numbers = {}
    for r in rows:
        numbers.setdefault(r["conv_id"], []).append(r["number"])
    assert all(sorted(n) == list(range(len(n))) for n in numbers.values())


def test_numbers_do_not_depend_on_the_partitions(spark):
    frame = conversations(spark, n=20, long=700)
    seen = []
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        seen.append(sorted(map(str, format_chats(frame).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_roles_are_recovered_without_their_labels(spark):
    """Markers are missing or misleading here and there; no transcript's own labels are in its model."""
    frame = conversations(spark, n=200)
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in frame.collect()}
    rows = format_chats(frame).collect()
    assert np.mean([r["role"] == truth[r["conv_id"], r["turn"]] for r in rows]) > 0.95
    raw = [(r["conv"], r["turn"], r["line"], r["text"]) for r in chat.transcripts(frame).collect()]
    led = [bool(re.match("(System|Instructions|Context|User|Human|Q|Assistant|AI|A): |\\[(system|user|bot)\\] ", t)) for *_, t in raw]
    assert 0.7 < np.mean([x for x, r in zip(led, raw, strict=True) if r[2] == 0]) < 0.95 and 0.05 < np.mean([x for x, r in zip(led, raw, strict=True) if r[2] > 0]) < 0.25


def test_many_paths_at_once():
    rng = np.random.default_rng(4)
    model = Model({(0, 2): 3, (2, 4): 5, (4, 5): 2}, {0: 4, 2: 3}, {(s, int(rng.integers(0, chat.SYMBOLS))): 9 for s in range(STATES) for _ in range(9)})
    many = [rng.integers(0, chat.SYMBOLS, n) for n in rng.integers(1, 40, 60)]
    assert all(np.array_equal(a, model.path(s)) for a, s in zip(model.paths(many), many, strict=True)) and model.paths([]) == []


def test_ids_of_any_type(spark):
    frame = spark.createDataFrame([("=x", 0, "user", "a"), ("", 0, "user", "b"), (None, 0, "user", "c"), ("7", 0, "user", "d")], "conv_id string, turn int, role string, text string")
    assert {(r["conv_id"], r["text"]) for r in format_chats(frame).collect()} == {("=x", "a"), ("", "b"), (None, "c"), ("7", "d")}


def test_rendering(spark):
    frame = conversations(spark, n=200)
    rows = sorted((r for r in format_chats(frame).collect() if r["conv_id"] == 0), key=lambda r: r["number"])
    text = "".join(r["rendered"] for r in rows)
    assert text.startswith("<|system|>\nLine 0 of 0 in 0.\n<|")
    # a turn's marker is gone; what is quoted within a turn stays
    assert all(r["text"].startswith("Line") for r in rows if r["begins"]) and text.count("<|") == sum(r["begins"] for r in rows)


def test_path_is_the_best_one():
    rng = np.random.default_rng(1)
    model = Model({}, {}, {})
    model.start, model.step = -rng.integers(1, 9, STATES), -rng.integers(1, 9, (STATES, STATES))
    model.seen = -rng.integers(1, 9, (STATES, 4))
    symbols = rng.integers(0, 4, 5)
    score = lambda p: model.start[p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:], strict=False)) + sum(model.seen[s, o] for s, o in zip(p, symbols, strict=True))
    best = max(score(p) for p in np.ndindex(*(STATES,) * 5))
    assert score(model.path(symbols)) == best == model.matrix(symbols)[STATES].max()
    first, second = model.matrix(symbols[:2]), model.matrix(symbols[2:])
    assert np.array_equal(chat.chain(first, second), model.matrix(symbols))


def test_markers(spark):
    lines = ["User: hi", "[BOT] yes", "<|system|> be", "Q : what?", "A", "", "plain text", "user hi"]
    got = [r[0] // chat.SHAPES for r in spark.createDataFrame([(x,) for x in lines], "t string").select(observe(F.col("t"))).collect()]
    assert got == [2, 3, 1, 2, 0, 0, 0, 0]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, None, None), (1, None, "assistant", ""), (1, 0, "narrator", "x\n\ny"), (1, 0, "narrator", "x\n\ny"), (2, 3, "user", "w " * 20_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = format_chats(frame).collect()
    assert len(out) == 2 + 1 + 6 + 1
    assert decoded(out) == whole_pass(frame)
    assert format_chats(frame.limit(0)).collect() == []
