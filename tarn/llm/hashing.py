"""64-bit hashes of the words and shingles of whole texts, for all texts of an Arrow batch at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarn.llm.piece import slices

BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    held = _powers.get("up")
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for name, base in (("up", BASE), ("down", inverse)):
            steps = np.full(size, _U(base))
            steps[0] = _U(1)
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def word_spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, where the words [^\\x20\\x09-\\x0D]+ start and stop in them, and where each text's words start (n + 1
    places). A null text has no words.
    """
    texts = texts.cast(pa.large_string())
    n = len(texts)
    lengths = np.asarray(pc.fill_null(pc.binary_length(texts), 0), "int64")
    ends = np.cumsum(lengths)
    raw = b"".join(x.as_buffer().to_pybytes() for x in texts if x.is_valid) if texts.null_count else _bytes(texts)
    data = np.frombuffer(raw, "uint8")
    if not len(data):
        return data, np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(n + 1, "int64")
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = edge[0] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
    return data, starts, stops, np.searchsorted(starts, np.append(0, ends))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words after lower-casing A-Z, and where each text's words start (n + 1 places)."""
    data, starts, stops, places = word_spans(texts)
    return hashes_of(data, starts, stops), places


def hashes_of(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, "uint64")
    data = _LOWER[data]
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, "uint64")
    np.cumsum((data.astype("uint64") + _U(1)) * up, out=sums[1:])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype("uint64"))


def _bytes(texts: pa.Array) -> memoryview:
    offsets = np.frombuffer(texts.buffers()[1], "int64", len(texts) + 1, texts.offset * 8)
    return memoryview(texts.buffers()[2] or b"")[offsets[0] : offsets[-1]]


def shingle_hashes(words: np.ndarray, places: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of size words, with repeats, and where each text's start; of fewer words, the whole sequence."""
    counts = np.diff(places)
    number = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.append(0, np.cumsum(number))
    factors = mix(np.arange(1, size + 1, dtype="uint64") * _U(BASE))
    factors |= _U(1)
    out = np.zeros(offsets[-1], "uint64")
    if len(words) >= size:
        runs = len(words) - size + 1
        every = np.zeros(runs, "uint64")
        for k in range(size):
            every += words[k : k + runs] * factors[k]
        long = counts >= size
        owner = np.repeat(np.arange(len(counts))[long], number[long])
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(number[long]) - number[long], number[long])
        out[offsets[owner] + inner] = every[places[owner] + inner]
    for k in np.flatnonzero((counts > 0) & (counts < size)):
        own = words[places[k] : places[k + 1]]
        out[offsets[k]] = (own * factors[: len(own)]).sum(dtype="uint64") + _U(len(own))
    return mix(out), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted and once each."""
    parts = [np.unique(values[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.concatenate([np.zeros(0, "uint64"), *parts]), np.append(0, np.cumsum([len(p) for p in parts], dtype="int64"))


def chunks(batch: pa.RecordBatch, text: int, at_most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have at most so many bytes."""
    for a, b in slices(batch.column(text), at_most):
        yield batch.slice(a, b - a)
