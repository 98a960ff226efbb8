"""Roles of a raw transcript's lines by a hidden Markov model, and canonical rendering.

States are role and place: the first line of a turn, or a later one. Observations are a line's speaker marker together
with its shape (capital first, closing mark, length). The model is counted from labelled transcripts with one added to
each count, in whole micro-nats, so sums are exact in any order. Viterbi finds the best states of each transcript.
Transcripts are in two halves by hash; each half is decoded with the model of the other, which has not seen its labels.

Transcripts may be of any length. Lines are sorted over range partitions; transcripts that lie within one partition and
are short are decoded many at a time, line by line. Others are cut into segments: each gives the matrix of its best scores from any state
before it to any state at its end; matrices are chained over a partition's segments, then over partitions (one matrix
each), which settles the state at every border, and segments are decoded between their borders. The result is the same
as in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.sources import scratch

ROLES = ("system", "user", "assistant")
#: Marker words of each role.
MARKERS = {
    "system": ("system", "instructions", "instruction", "context", "sys"),
    "user": ("user", "human", "customer", "question", "prompt", "q"),
    "assistant": ("assistant", "ai", "bot", "agent", "answer", "model", "a"),
}
STATES = 2 * len(ROLES)  # 2 * role is a first line, 2 * role + 1 a later one
SHAPES = 2 * 2 * 4
SYMBOLS = 4 * SHAPES
SEGMENT = 512
#: Lines that are decoded at a time.
TOGETHER = 8_192
SCALE = 1_000_000
_ANY = "|".join(w for words in MARKERS.values() for w in sorted(words, key=len, reverse=True))
MARKER = rf"(?i)^[\x20\t]*(?:\[({_ANY})\]|<\|?({_ANY})\|?>|({_ANY})[\x20\t]*:)[\x20\t]*"


def observe(line: Column) -> Column:
    """A line's symbol: marker, capital first, closing mark, length."""
    word = F.lower(F.concat(*[F.regexp_extract(line, MARKER, k) for k in (1, 2, 3)]))
    marker = F.lit(0)
    for k, role in enumerate(ROLES):
        marker = F.when(word.isin(*MARKERS[role]), k + 1).otherwise(marker)
    body = F.regexp_replace(line, MARKER, "")
    n = F.length(body)
    size = F.when(n == 0, 0).when(n < 80, 1).when(n < 300, 2).otherwise(3)
    return (marker * SHAPES + body.rlike(r"^\p{Lu}").cast("int") * 8 + body.rlike(r"[?!]\s*$").cast("int") * 4 + size).cast("int")


class Model:
    """Scores in micro-nats: start[state], step[state][state], seen[state][symbol]."""

    def __init__(self, steps: dict[tuple[int, int], int], starts: dict[int, int], seen: dict[tuple[int, int], int]):
        def logs(table: np.ndarray) -> np.ndarray:
            return np.round(np.log(table / table.sum(-1, keepdims=True)) * SCALE).astype("int64")

        start, step, emit = np.ones(STATES), np.ones((STATES, STATES)), np.ones((STATES, SYMBOLS))
        for k, n in starts.items():
            start[k] += n
        for k, n in steps.items():
            step[k] += n
        for k, n in seen.items():
            emit[k] += n
        never = np.zeros((STATES, STATES), bool)
        for a in range(STATES):
            for b in range(1, STATES, 2):
                never[a, b] = a // 2 != b // 2  # a later line follows a line of its own role
        self.start, self.step, self.seen = logs(start), logs(step), logs(emit)
        self.start[1::2] = -(1 << 50)
        self.step[never] = -(1 << 50)

    def matrix(self, symbols: np.ndarray) -> np.ndarray:
        """Best scores from each state before the lines (last row: none) to each state of the last line."""
        m = np.vstack([self.step, self.start]) + self.seen[:, symbols[0]]
        for s in symbols[1:]:
            m = (m[:, :, None] + self.step[None]).max(1) + self.seen[:, s]
        return m

    def path(self, symbols: np.ndarray, before: int = STATES, last: int | None = None) -> np.ndarray:
        """The best states, given the one before (STATES: none) and, if given, the last one."""
        rows = np.vstack([self.step, self.start])
        score = rows[before] + self.seen[:, symbols[0]]
        back = np.zeros((len(symbols), STATES), "int8")
        for k, s in enumerate(symbols[1:], 1):
            every = score[:, None] + self.step
            back[k] = every.argmax(0)
            score = every.max(0) + self.seen[:, s]
        out = np.zeros(len(symbols), "int8")
        out[-1] = score.argmax() if last is None else last
        for k in range(len(symbols) - 1, 0, -1):
            out[k - 1] = back[k, out[k]]
        return out

    def paths(self, many: list[np.ndarray]) -> list[np.ndarray]:
        """path() of each transcript, all at once: those of most lines first, so the ones still running are a prefix."""
        if not many:
            return []
        order = sorted(range(len(many)), key=lambda i: -len(many[i]))
        length = np.array([len(many[i]) for i in order])
        symbols = np.zeros((len(order), length[0]), "int64")
        for row, i in enumerate(order):
            symbols[row, : length[row]] = many[i]
        score = self.start + self.seen[:, symbols[:, 0]].T
        back = np.zeros((*symbols.shape, STATES), "int8")
        for k in range(1, symbols.shape[1]):
            n = int(np.searchsorted(-length, -k, "left"))  # of more than k lines
            every = score[:n, :, None] + self.step
            back[:n, k] = every.argmax(1)
            score[:n] = every.max(1) + self.seen[:, symbols[:n, k]].T
        out = np.zeros(symbols.shape, "int8")
        out[np.arange(len(order)), length - 1] = score.argmax(1)
        for k in range(symbols.shape[1] - 1, 0, -1):
            n = int(np.searchsorted(-length, -k, "left"))
            out[:n, k - 1] = back[np.arange(n), k, out[:n, k]]
        found = dict(zip(order, (row[:n] for row, n in zip(out, length, strict=True)), strict=True))
        return [found[i] for i in range(len(many))]


def chain(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return (first[:, :, None] + second[None, :STATES]).max(1)


def borders(matrices: list[np.ndarray], before: int = STATES, last: int | None = None) -> list[int]:
    """The state at the end of each matrix of a chain."""
    score, back = matrices[0][before], []
    for m in matrices[1:]:
        every = score[:, None] + m[:STATES]
        back.append(every.argmax(0))
        score = every.max(0)
    out = [int(score.argmax()) if last is None else last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def fit(lines: DataFrame) -> Model:
    """Counts over all lines with a known role: lines has conv, turn, line, role and symbol."""
    role = F.lit(None).cast("int")
    for k, name in enumerate(ROLES):
        role = F.when(F.col("role") == name, k).otherwise(role)
    known = lines.withColumn("of", role).where("of is not null")
    state = F.col("of") * 2 + (F.col("line") > 0).cast("int")
    seen = {(r[0], r[1]): r[2] for r in known.groupBy(state.alias("s"), "symbol").count().collect()}  # at most STATES * SYMBOLS rows
    turns = known.groupBy("conv", "turn", "of").agg((F.max("line") + 1).alias("n"))
    inner = turns.groupBy("of").agg(F.sum((F.col("n") > 1).cast("long")).alias("more"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("rest")).collect()
    steps: dict[tuple[int, int], int] = {}
    for r in inner:
        steps[2 * r["of"], 2 * r["of"] + 1] = r["more"]
        steps[2 * r["of"] + 1, 2 * r["of"] + 1] = r["rest"]
    after = turns.select("conv", (F.col("turn") - 1).alias("turn"), F.col("of").alias("next"))
    pairs = turns.join(after, ["conv", "turn"]).groupBy(F.when(F.col("n") > 1, 1).otherwise(0).alias("long"), "of", "next").count().collect()
    for r in pairs:
        steps[2 * r["of"] + r["long"], 2 * r["next"]] = r["count"]
    starts = {2 * r["of"]: r["count"] for r in turns.where("turn = 0").groupBy("of").count().collect()}
    return Model(steps, starts, seen)


_COLUMNS = ["conv", "half", "part", "seg", "idx", "turn", "line", "text", "symbol", "state"]
_SCHEMA = "conv string, half int, part int, seg long, idx long, turn long, line int, text string, symbol int, state int"


def _first_pass(models: list[Model]):
    """Numbers the lines of a sorted partition and decodes the transcripts that surely lie within it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        pieces: list[tuple[pa.Table, int, int, bool]] = []  # lines, their first number, the segment, whether it is all
        held: list[pa.RecordBatch] = []
        name, count, idx, seg, first, waiting = None, 0, 0, 0, True, 0

        def cut(whole: bool) -> None:
            nonlocal held, count, waiting
            pieces.append((pa.Table.from_batches(held), idx, seg, whole))
            waiting += count
            held, count = [], 0

        def decoded() -> pa.RecordBatch:
            nonlocal pieces, waiting
            table = pa.concat_tables([p[0] for p in pieces]).combine_chunks()
            lengths = [p[0].num_rows for p in pieces]
            starts = np.cumsum([0, *lengths])
            half, symbols = table.column(1).to_numpy(), table.column(5).to_numpy()
            state, known = np.zeros(table.num_rows, "int32"), np.repeat([p[3] for p in pieces], lengths)
            for h, model in enumerate(models):
                own = [(a, a + n) for p, a, n in zip(pieces, starts, lengths, strict=False) if p[3] and half[a] == h]
                for (a, b), path in zip(own, model.paths([symbols[a:b] for a, b in own]), strict=True):
                    state[a:b] = path
            places = [pa.array(np.full(table.num_rows, part, "int32")), pa.array(np.repeat([p[2] for p in pieces], lengths), pa.int64()), pa.array(np.concatenate([np.arange(p[1], p[1] + n) for p, n in zip(pieces, lengths, strict=True)]), pa.int64())]
            columns = [table.column(0), table.column(1), *places, *(table.column(i) for i in (2, 3, 4, 5)), pa.array(state, pa.int32(), mask=~known)]
            pieces, waiting = [], 0
            return pa.Table.from_arrays(columns, names=_COLUMNS).combine_chunks().to_batches()[0]

        for batch in batches:
            names = batch.column(0)
            turns = np.flatnonzero(pc.not_equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)) + 1 if batch.num_rows > 1 else []
            for a, b in zip([0, *turns], [*turns, batch.num_rows], strict=True):
                if a == b:
                    continue
                if held and names[a].as_py() != name:
                    # the first transcript of a partition may have begun before it, a cut one is not whole
                    cut(seg == 0 and not first)
                    first, idx, seg = False, 0, 0
                name = names[a].as_py()
                while a < b:
                    if count == SEGMENT:
                        cut(False)
                        idx, seg = idx + SEGMENT, seg + 1
                    n = min(SEGMENT - count, b - a)
                    held.append(batch.slice(a, n))
                    count, a = count + n, a + n
                if waiting >= TOGETHER:
                    yield decoded()
        if held:
            cut(False)
        if pieces:
            yield decoded()

    return run


def _matrices(models: list[Model]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        one = rows.iloc[0]
        return pd.DataFrame({"conv": [one["conv"]], "part": [one["part"]], "seg": [one["seg"]], "n": [len(rows)], "matrix": [models[one["half"]].matrix(rows["symbol"].to_numpy()).ravel()]})

    return run


def _square(flat) -> np.ndarray:
    return np.asarray(flat, "int64").reshape(STATES + 1, STATES)


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seg")
    whole = None
    for flat in rows["matrix"]:
        whole = _square(flat) if whole is None else chain(whole, _square(flat))
    return pd.DataFrame({"conv": [rows["conv"].iloc[0]], "part": [rows["part"].iloc[0]], "n": [rows["n"].sum()], "matrix": [whole.ravel()]})


def _outer(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("part")
    ends = borders([_square(m) for m in rows["matrix"]])
    return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "lines_before": rows["n"].cumsum() - rows["n"], "before": [STATES, *ends[:-1]], "last": ends})


def _inner(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("seg")
    before, last = int(rows["before"].iloc[0]), int(rows["last"].iloc[0])
    ends = borders([_square(m) for m in rows["matrix"]], before, last)
    return pd.DataFrame({"conv": rows["conv"], "part": rows["part"], "seg": rows["seg"], "lines_before": rows["lines_before"], "before": [before, *ends[:-1]], "last": ends})


def _decoded(models: list[Model]):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        one = rows.iloc[0]
        rows["state"] = models[one["half"]].path(rows["symbol"].to_numpy(), int(one["before"]), int(one["last"])).astype("int32")
        rows["idx"] += one["lines_before"]
        return rows[_COLUMNS]

    return run


def decode(lines: DataFrame, models: list[Model]) -> DataFrame:
    """lines (conv, half, turn, line, text, symbol) with their number in the transcript and their state, by the model of
    their half. Lines of a transcript are in the order of turn, line and the text's hash, however they are dealt out."""
    ordered = lines.select("conv", "half", "turn", "line", "text", "symbol", F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("conv", "turn", "line", "tie").sortWithinPartitions("conv", "turn", "line", "tie").drop("tie")
    rows = scratch(ordered.mapInArrow(_first_pass(models), _SCHEMA), "chat-lines")
    left = rows.where("state is null")
    matrices = scratch(left.groupBy("conv", "part", "seg").applyInPandas(_matrices(models), "conv string, part int, seg long, n long, matrix array<long>"), "chat-segments")
    parts = matrices.groupBy("conv", "part").applyInPandas(_chained, "conv string, part int, n long, matrix array<long>")
    outer = parts.groupBy("conv").applyInPandas(_outer, "conv string, part int, lines_before long, before int, last int")
    inner = matrices.join(outer, ["conv", "part"]).groupBy("conv", "part").applyInPandas(_inner, "conv string, part int, seg long, lines_before long, before int, last int")
    rest = left.join(inner, ["conv", "part", "seg"]).groupBy("conv", "part", "seg").applyInPandas(_decoded(models), _SCHEMA)
    return rows.where("state is not null").unionByName(rest).withColumnRenamed("idx", "number").drop("part", "seg")


def render(decoded: DataFrame) -> DataFrame:
    """Canonical lines: a turn's first line has its header before it; markers are gone.

    A transcript's canonical text is the concatenation of rendered in the order of number.
    """
    role = F.element_at(F.array(*[F.lit(r) for r in ROLES]), (F.floor(F.col("state") / 2) + 1).cast("int"))
    begins = F.col("state") % 2 == 0
    body = F.when(begins, F.regexp_replace("text", MARKER, "")).otherwise(F.col("text"))
    header = F.when(begins, F.concat(F.lit("<|"), role, F.lit("|>\n"))).otherwise(F.lit(""))
    return decoded.select("conv", "turn", "line", "number", role.alias("role"), begins.alias("begins"), body.alias("text"), F.concat(header, body, F.lit("\n")).alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """Raw transcript lines of labelled conversations: conv, turn, line, role, text.

    Each conversation writes its speakers in one of four styles. One turn in six after the first has no marker, and one
    line in eight within a turn begins with the marker of some role, as quotations do; all by hash. Defined cases: null ids
    make one transcript of their own; ids may be of any type; a null text is one empty line; null turns come first;
    repeated rows stay, in the order of their texts' hashes; columns other than conv_id, turn, role and text are ignored.
    """
    conv = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    style = (F.pmod(F.xxhash64("conv_id"), F.lit(4)) + 1).cast("int")
    named = {"system": ("System: ", "Instructions: ", "[system] ", "Context: "), "user": ("User: ", "Human: ", "[user] ", "Q: "), "assistant": ("Assistant: ", "AI: ", "[bot] ", "A: ")}
    names = F.create_map(*[x for role, words in named.items() for x in (F.lit(role), F.array(*map(F.lit, words)))])
    bare = (F.pmod(F.xxhash64("conv_id", "turn", F.lit(1)), F.lit(6)) == 0) & (F.coalesce(F.col("turn"), F.lit(0)) > 0)
    marker = F.when(bare, F.lit("")).otherwise(F.coalesce(F.element_at(names[F.col("role")], style), F.lit("")))
    rows = conversations.select(
        conv.alias("conv"), F.col("turn").cast("long").alias("turn"), "role", style.alias("style"),
        F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line", "raw"), marker.alias("marker"),
    )
    draw = F.xxhash64("conv", "turn", "line", "raw")
    other = F.element_at(names[F.element_at(F.array(*map(F.lit, ROLES)), (F.pmod(F.shiftright(draw, 8), F.lit(3)) + 1).cast("int"))], F.col("style"))
    quoted = F.when(F.pmod(draw, F.lit(8)) == 0, other).otherwise(F.lit(""))
    return rows.select("conv", "turn", "line", "role", F.concat(F.when(F.col("line") == 0, F.col("marker")).otherwise(quoted), "raw").alias("text"))


def halves(lines: DataFrame) -> DataFrame:
    return lines.withColumn("half", F.pmod(F.xxhash64("conv", F.lit(3)), F.lit(2)).cast("int"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """Raw transcripts of the conversations, their roles recovered without looking at the labels of the rows decoded.

    The labels of each half of the conversations make the model that decodes the other. Returns one row per line: conv_id,
    turn, line, number (from 0, its place in the transcript), role, begins, text, rendered. An empty table gives no rows.
    """
    lines = scratch(halves(transcripts(conversations).withColumn("symbol", observe(F.col("text")))), "chat-raw")
    models = [fit(lines.where(F.col("half") == 1 - half)) for half in (0, 1)]
    out = render(decode(lines.drop("role"), models))
    kind = conversations.schema["conv_id"].dataType
    return out.withColumn("conv_id", F.when(F.col("conv") != "", F.substring("conv", 2, 1 << 30).cast(kind))).drop("conv")
