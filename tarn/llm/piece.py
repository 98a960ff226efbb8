"""Encoding with merge-type piece vocabularies, by a score-ordered agenda of adjacent symbol pairs.

A text becomes one run of symbols (spaces written as U+2581). The agenda is a heap of the adjacent pairs whose
concatenation is a piece, best score first and leftmost on ties; popping a pair joins it and offers the two new
neighbours. Symbols that are no piece in the end fall back to bytes.

No piece of such a vocabulary has U+2581 after another character, so no merge crosses the place before a run of U+2581:
each segment between two such places is encoded alone and remembered. This is checked when the vocabulary is loaded;
where it does not hold, whole texts are the segments. Every segment not seen before is compared with what the
sentencepiece library gives, in one call for each Arrow batch; a difference raises an error.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Remembered segments of a Python worker; beyond this the memory starts afresh.
MEMORY = 200_000
#: Longer segments are not remembered.
LONGEST = 200
#: Segments of more characters have their agenda in a heap, one by one; shorter ones in arrays, many at once.
SHORT = 64


class PieceEncoder:
    """One vocabulary in one process."""

    def __init__(self, model: str, memory: int = MEMORY, check: bool = True):
        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        self.check, self.limit = check, memory
        pieces = range(self.library.get_piece_size())
        ordinary = [i for i in pieces if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in ordinary}
        self.rank = {p: -self.library.get_score(i) for p, i in self.ids.items()}
        self.bytes = {int(self.library.id_to_piece(i)[3:-1], 16): i for i in pieces if self.library.is_byte(i)}
        self.unknown = self.library.unk_id()
        self.begin, self.end = self.library.bos_id(), self.library.eos_id()
        self.split = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        # the library alone knows whether it puts a space first: ask it
        self.prefix = self.library.encode("a", out_type=str)[0].startswith(SPACE)
        self.known: dict[str, bytes] = {}
        self._tables()

    def _tables(self) -> None:
        """For many short segments at once: which two symbols join to which, as an open-addressed hash table."""
        pieces = sorted(self.ids, key=self.ids.get)
        size = self.library.get_piece_size()
        self.symbol = np.full(0x110000, -1, "int32")
        single = {p for p in pieces if len(p) == 1}
        for p in single:
            self.symbol[ord(p)] = self.ids[p]
        # characters that are no piece, but parts of one, get numbers of their own
        inner = sorted({c for p in pieces for c in p} - single)
        for k, c in enumerate(inner):
            self.symbol[ord(c)] = size + k
        number = self.ids | {c: size + k for k, c in enumerate(inner)}
        self.plain = size
        self.order = np.full(size, np.inf)
        for p, i in self.ids.items():
            self.order[i] = self.rank[p]
        found = [(number[p[:k]], number[p[k:]], self.ids[p]) for p in pieces for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.mask = (1 << max(4, (4 * len(found)).bit_length())) - 1
        self.keys, self.joined = np.full(self.mask + 1, -1, "int64"), np.full(self.mask + 1, -1, "int32")
        slots = self._slot(np.array([a << 32 | b for a, b, _ in found], "int64")).tolist() if found else []
        for slot, (a, b, c) in zip(slots, found, strict=True):
            while self.keys[slot] >= 0:
                slot = slot + 1 & self.mask
            self.keys[slot], self.joined[slot] = a << 32 | b, c

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype("uint64") * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype("int64") & self.mask

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that two symbols make, or -1."""
        keys = left.astype("int64") << 32 | right
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.joined[slot], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while len(todo):
            slot[todo] = slot[todo] + 1 & self.mask
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.joined[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out

    def agendas(self, segments: list[str]) -> list[bytes]:
        """What agenda() gives for each of many segments: every round takes the best pair, leftmost on ties, from the
        agenda of each segment that still has one."""
        out: list[bytes | None] = [None] * len(segments)
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), "<u4")
        lengths = np.fromiter(map(len, segments), "int64", len(segments))
        symbols = self.symbol[points]
        owner = np.repeat(np.arange(len(segments)), lengths)
        odd = np.zeros(len(segments), bool)
        odd[owner[(symbols < 0) | (symbols >= self.plain)]] = True
        odd |= (lengths > SHORT) | (lengths == 0)
        for k in np.flatnonzero(odd):
            out[k] = np.asarray(self.agenda(segments[k]), "<u4").tobytes()
        keep = ~odd[owner]
        symbols, owner = symbols[keep], owner[keep]
        while len(symbols):
            # a pair is held at its left symbol; the last symbol of a segment has none
            last = np.append(owner[1:] != owner[:-1], True)
            joined = np.where(last, np.int32(-1), self._join(symbols, np.append(symbols[1:], np.int32(0))))
            order = np.where(joined >= 0, self.order[joined], np.inf)
            while True:
                starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
                best = np.minimum.reduceat(order, starts)
                ended = np.isinf(best)
                if ended.any():
                    sizes = np.diff(np.append(starts, len(owner)))
                    gone = np.repeat(ended, sizes)
                    ids = symbols[gone].astype("<u4").tobytes()
                    ends = np.cumsum(sizes[ended]) * 4
                    for k, a, b in zip(owner[starts[ended]].tolist(), (ends - sizes[ended] * 4).tolist(), ends.tolist(), strict=True):
                        out[k] = ids[a:b]
                    stay = ~gone
                    symbols, owner, joined, order = symbols[stay], owner[stay], joined[stay], order[stay]
                    if not len(symbols):
                        break
                    sizes, best = sizes[~ended], best[~ended]
                    starts = np.cumsum(sizes) - sizes
                else:
                    sizes = np.diff(np.append(starts, len(owner)))
                hits = np.flatnonzero(order == np.repeat(best, sizes))
                at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
                symbols[at] = joined[at]
                stay = np.ones(len(symbols), bool)
                stay[at + 1] = False
                place = np.cumsum(stay) - 1
                symbols, owner, joined, order = symbols[stay], owner[stay], joined[stay], order[stay]
                at = place[at]
                renew = np.concatenate([at, at[at > 0] - 1])
                right = np.minimum(renew + 1, len(symbols) - 1)
                same = (owner[right] == owner[renew]) & (right > renew)
                new = np.where(same, self._join(symbols[renew], symbols[right]), np.int32(-1))
                joined[renew] = new
                order[renew] = np.where(new >= 0, self.order[new], np.inf)
        return out

    def agenda(self, segment: str) -> list[int]:
        """The ids of one segment of symbols."""
        whole = self.ids.get(segment)
        rank = self.rank
        symbols: list[str | None] = list(segment)
        n = len(symbols)
        if n == 1 and whole is not None:
            return [whole]
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                heap.append((rank[pair], i, pair))
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            left = symbols[i]
            if left is None:
                continue
            j = after[i]
            if j >= n or len(left) + len(symbols[j]) != len(pair) or left + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = pair + symbols[k]
                if new in rank:
                    heapq.heappush(heap, (rank[new], i, new))
            h = before[i]
            if h >= 0:
                new = symbols[h] + pair
                if new in rank:
                    heapq.heappush(heap, (rank[new], h, new))
        out = []
        for s in symbols:
            if s is None:
                continue
            found = self.ids.get(s)
            if found is not None:
                out.append(found)
            elif self.bytes:
                out.extend(self.bytes[b] for b in s.encode("utf-8"))
            else:
                out.append(self.unknown)
        return out

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        body = text.replace(" ", SPACE)
        if self.prefix:
            body = SPACE + body
        if not self.split:
            return [body]
        if SPACE + SPACE in body:
            return SEGMENT.findall(body)
        parts = body.split(SPACE)
        head = [parts[0]] if parts[0] else []
        out = head + [SPACE + p for p in parts[1:]]
        return out

    def _learn(self, segments: Iterable[str]) -> dict[str, bytes]:
        """Encodes segments by the agenda and compares them with the library, in one call."""
        new = list(segments)
        found = self.agendas(new)
        if self.check:
            # the library puts a space before every text, so hand over the segments that begin with one, without it
            asked = [k for k, s in enumerate(new) if not self.prefix or s.startswith(SPACE) and len(s) > 1]
            said = self.library.encode([new[k][1:] if self.prefix else new[k] for k in asked], num_threads=1)
            ours = np.frombuffer(b"".join([found[k] for k in asked]), "<u4")
            theirs = np.fromiter(chain.from_iterable(said), "<u4")
            if not np.array_equal(ours, theirs) or list(map(len, said)) != [len(found[k]) // 4 for k in asked]:
                bad = next(k for k, ids in zip(asked, said, strict=True) if np.asarray(ids, "<u4").tobytes() != found[k])
                raise ValueError(f"the agenda and the library differ on segment {new[bad][:80]!r}")
        return dict(zip(new, found, strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, without begin and end, as little-endian unsigned 32-bit integers."""
        cut = [self.segments(t or "") for t in texts]
        if len(self.known) > self.limit:
            self.known = {}
        known = self.known
        fresh = set(chain.from_iterable(cut)).difference(known)
        long = {}
        if fresh:
            learnt = self._learn(fresh)
            long = {s: i for s, i in learnt.items() if len(s) > LONGEST}
            known.update((s, i) for s, i in learnt.items() if len(s) <= LONGEST)
        if not long:
            return [b"".join(map(known.__getitem__, segments)) for segments in cut]
        return [b"".join(known[s] if s in known else long[s] for s in segments) for segments in cut]

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.library.decode([np.frombuffer(x, "<u4").tolist() for x in ids])


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(model: str, memory: int = MEMORY, check: bool = True) -> PieceEncoder:
    key = (model, memory, check)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def slices(texts: pa.Array, at_most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most so many bytes (but one row at least)."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), "int64")
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > at_most:
            yield start, i
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield start, len(lengths)


def encode_documents(docs: DataFrame, model: str, doc_id: str = "doc_id", text: str = "text", memory: int = MEMORY, check: bool = True, with_ids: bool = False) -> DataFrame:
    """Ids with begin and end of every whole text, decoded again by the library's decode(ids).

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids (array<int>) and decoded.
    model is the vocabulary's path on every executor. Defined cases: a null text is encoded as the empty one (begin and
    end only); repeated rows give repeated rows; a null doc_id is kept; other columns are ignored; an empty table gives
    no rows. A text without spaces is one segment, of any length.
    """
    fields = [("doc_id", None), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(model, memory, check)
        begin, end = (np.asarray([i], "<u4").tobytes() for i in (coder.begin, coder.end))
        for batch in batches:
            for a, b in slices(batch.column(1)):
                ids = [begin + x + end for x in coder.encode(batch.column(1).slice(a, b - a).to_pylist())]
                decoded = coder.decode(ids)
                columns = [
                    batch.column(0).slice(a, b - a),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(x.encode("utf-8")).hexdigest() for x in decoded], pa.string()),
                ]
                names = [f[0] for f in fields]
                if with_ids:
                    columns += [pa.array([np.frombuffer(x, "<u4").astype("int32") for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
