"""Token ids in files: each document compressed alone with a shared zstandard dictionary.

Files. A folder holds dictionary/ (one row: hash, bytes) and segments/. A segment is one binary value, the same bytes
in memory and on disk:

    4 bytes   magic TRNZ
    u16 u16   version 1; bytes per id, 2 or 4
    32 bytes  SHA-256 of the dictionary (zeros: none)
    u32       n, the documents in it
    u8[n]     1 where the doc_id is null
    i64[n]    doc_ids (0 where null)
    u32[n]    ids per document
    u64[n+1]  where each document's frame starts, from the first frame
    frames    zstandard frames of little-endian ids

Segments lie in Parquet as (part, seq, tokens, segment), so any store that Spark writes will do and a lost executor's
tasks are simply run again; their order by (part, seq) is the ascending order of doc_id. One document is read from its
segment by its entry in the offset index alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.piece import slices
from tarn.llm.skew import least_hashed

MAGIC, HEAD = b"TRNZ", struct.Struct("<4sHH32sI")
#: Pieces that surely start a pretoken: letters up to a punctuation mark or to a space before a non-blank (which the next
#: piece takes), else everything up to such a space. The apostrophe is left out, for contractions.
LETTERS = r"a-zA-Z\xc0-\xd6\xd8-\xf6\xf8-\xff"
PIECE = re.compile(rf" ?[{LETTERS}]+(?=[!-&(-/:-@\[-`{{-~]| \S|\Z)|.+?(?= \S|\Z)", re.S)
MEMORY, LONGEST = 800_000, 200
SEGMENT_IDS, SEGMENT_DOCS = 500_000, 2_000
#: Bytes of text that a task writes, on average.
TASK_BYTES = 64 << 20


class TokenEncoder:
    """The library's ids of whole texts; pieces of text between certain pretoken limits are encoded once."""

    def __init__(self, path: str, memory: int = MEMORY):
        self.library = tokenizers.Tokenizer.from_file(path)
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # it sees each piece once
        self.width = 2 if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        special = [(i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.separator_id, self.separator = special[0] if special else (None, None)
        form = str(self.library.pre_tokenizer)
        self.split = form.startswith("ByteLevel(") and "use_regex=True" in form and "add_prefix_space=False" in form and self.library.normalizer is None
        self.memory, self.known = memory, {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids as little-endian unsigned integers of self.width bytes."""
        whole = {t for t in texts if t and (not self.split or any(a in t for a in self.added))}
        cut = [[t] if t in whole else PIECE.findall(t or "") for t in texts]
        if len(self.known) > self.memory:
            self.known = {}
        known, fresh = self.known, list(set(chain.from_iterable(cut)).difference(self.known))
        kind, long = f"<u{self.width}", {}
        odd, plain = ([], fresh) if self.separator and not whole else ([s for s in fresh if s in whole or not self.separator], [s for s in fresh if s not in whole and self.separator])
        for start in range(0, len(plain), 20_000):
            # many pieces in one text, apart by a special token: the library encodes what is between them by itself
            some = plain[start : start + 20_000]
            joined = [self.separator.join(some[k : k + 2_000]) + self.separator for k in range(0, len(some), 2_000)]
            found = [e.ids for e in self.library.encode_batch_fast(joined, add_special_tokens=False)]
            ids = np.fromiter(chain.from_iterable(found), "<u4")
            stops = np.flatnonzero(ids == self.separator_id) * self.width
            ids = ids.astype(kind).tobytes()
            starts = np.append(0, stops[:-1] + self.width)
            learnt = dict(zip(some, [ids[a:b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)], strict=True))
            if max(map(len, some)) > LONGEST:
                long |= {s: i for s, i in learnt.items() if len(s) > LONGEST}
                learnt = {s: i for s, i in learnt.items() if len(s) <= LONGEST}
            known.update(learnt)
        for s, e in zip(odd, self.library.encode_batch_fast(odd, add_special_tokens=False) if odd else [], strict=True):
            (known if len(s) <= LONGEST else long)[s] = np.array(e.ids, kind).tobytes()
        if not long:
            return [b"".join(map(known.__getitem__, pieces)) for pieces in cut]
        return [b"".join(known[p] if p in known else long[p] for p in pieces) for pieces in cut]


_encoders: dict[str, TokenEncoder] = {}


def encoder(path: str) -> TokenEncoder:
    if path not in _encoders:
        _encoders[path] = TokenEncoder(path)
    return _encoders[path]


def pack(doc_ids: list[int | None], ids: list[bytes], width: int, dictionary: bytes) -> bytes:
    """One segment."""
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    press = zstandard.ZstdCompressor(level=3, dict_data=shared, write_content_size=True)
    frames = [press.compress(x) for x in ids]
    n = len(ids)
    mark = hashlib.sha256(dictionary).digest() if dictionary else bytes(32)
    return b"".join([
        HEAD.pack(MAGIC, 1, width, mark, n),
        bytes(d is None for d in doc_ids),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        np.array([len(x) // width for x in ids], "<u4").tobytes(),
        np.cumsum([0, *map(len, frames)], dtype="<u8").tobytes(),
        *frames,
    ])


class Segment:
    """Reads one segment; ids(k) opens the k-th document's frame only."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, mark, n = HEAD.unpack_from(data)
        if magic != MAGIC or version != 1:
            raise ValueError("not a segment of this format")
        if mark != (hashlib.sha256(dictionary).digest() if dictionary else bytes(32)):
            raise ValueError("the segment was written with another dictionary")
        at = HEAD.size
        null = np.frombuffer(data, "u1", n, at)
        keys = np.frombuffer(data, "<i8", n, at + n)
        self.doc_ids = [None if x else int(k) for x, k in zip(null, keys, strict=True)]
        self.counts = np.frombuffer(data, "<u4", n, at + 9 * n)
        self.offsets = np.frombuffer(data, "<u8", n + 1, at + 13 * n).astype("int64") + at + 13 * n + 8 * (n + 1)
        self.data = data
        self.opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def __len__(self) -> int:
        return len(self.counts)

    def ids(self, k: int) -> np.ndarray:
        frame = self.data[self.offsets[k] : self.offsets[k + 1]]
        found = np.frombuffer(self.opener.decompress(frame), f"<u{self.width}")
        if len(found) != self.counts[k]:
            raise ValueError(f"document {k} of the segment has {len(found)} ids, its index says {self.counts[k]}")
        return found


def train_dictionary(docs: DataFrame, tokenizer: str, total: int, documents: int = 500, sample_bytes: int = 4_000_000, size: int = 65_536) -> bytes:
    """A dictionary from the ids of a bounded sample: of total documents those of smallest hash, until sample_bytes of ids.

    Where the sample is too small to train on, there is none (empty bytes) and frames are compressed without one.
    """
    some = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("hash"))
    some = least_hashed(some, ["hash", "doc_id"], documents, total).drop("hash")
    samples, held = [], 0
    for row in some.repartition(8).mapInArrow(_ids(tokenizer), "ids binary").toLocalIterator():
        samples.append(bytes(row[0]))
        held += len(samples[-1])
        if held >= sample_bytes:
            break
    try:
        return zstandard.train_dictionary(min(size, max(256, held // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _ids(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(coder.encode(batch.column(1).to_pylist()), pa.binary())], names=["ids"])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of every whole text, each with end_id behind it, in ascending order of doc_id.

    tokenizer is the vocabulary's path on every executor. Defined cases: a null text is the empty one (end_id alone); a
    null doc_id comes first; repeated doc_ids follow each other, in the order of their texts' hashes; other columns are
    ignored; an empty table writes no segment.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    dictionary = train_dictionary(docs, tokenizer, total)
    mark = hashlib.sha256(dictionary).hexdigest() if dictionary else None
    spark.createDataFrame([(mark, dictionary)], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seq = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], f"<u{coder.width}").tobytes()
        keys: list = []
        held: list[bytes] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int64()), pa.array([tokens], pa.int64()), pa.array([pack(keys, held, coder.width, dictionary)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seq", "tokens", "segment"])

        for batch in batches:
            for a, b in slices(batch.column(1), 4_000_000):
                found = coder.encode(batch.column(1).slice(a, b - a).to_pylist())
                for key, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), found, strict=True):
                    keys.append(key)
                    held.append(ids + end)
                    tokens += len(held[-1]) // coder.width
                    if tokens >= SEGMENT_IDS or len(held) >= SEGMENT_DOCS:
                        yield flush()
                        keys, held, tokens, seq = [], [], 0, seq + 1
        if held:
            yield flush()

    # as many ranges as the text needs; rows of one doc_id may lie in several, in the order of their hashes
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    ordered = docs.repartitionByRange(ranges, "doc_id", "hash").sortWithinPartitions("doc_id", "hash").drop("hash")
    ordered.mapInArrow(run, "part int, seq long, tokens long, segment binary").write.parquet(f"{path}/segments")


def read_tokens(spark, path: str) -> DataFrame:
    """Every document in the files: doc_id, start, n_tokens, ids_crc32, part, seq, slot and ids' width.

    start counts the ids of all documents before it: sums over parts, then over the segments of a part, then within the
    segment; no task sees more than one part's segments.
    """
    dictionary = _dictionary(spark, path)
    segments = spark.read.parquet(f"{path}/segments")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                segment = Segment(data, dictionary)
                n = len(segment)
                counts = segment.counts.astype("int64")
                crcs = [zlib.crc32(segment.ids(k).astype("<u4").tobytes()) for k in range(n)]
                columns = [
                    pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(segment.doc_ids, pa.int64()),
                    pa.array(np.cumsum(counts) - counts), pa.array(counts), pa.array(crcs, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seq", "slot", "doc_id", "inner", "n_tokens", "ids_crc32"])

    found = segments.select("part", "seq", "segment").mapInArrow(run, "part int, seq long, slot int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    before = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("tokens")).select("part", before(Window.orderBy("part")).alias("of_part"))
    starts = segments.select("part", "seq", "tokens", before(Window.partitionBy("part").orderBy("seq")).alias("of_segment")).drop("tokens")
    starts = starts.join(parts, "part").select("part", "seq", (F.col("of_part") + F.col("of_segment")).alias("base"))
    out = found.join(starts, ["part", "seq"])
    return out.select("doc_id", (F.col("base") + F.col("inner")).cast("long").alias("start"), "n_tokens", "ids_crc32", "part", "seq", "slot")


def _dictionary(spark, path: str) -> bytes:
    return bytes(spark.read.parquet(f"{path}/dictionary").first()["bytes"])


def read_document(spark, path: str, part: int, seq: int, slot: int) -> list[int]:
    """The ids of one document, by its place; opens one frame of one segment."""
    row = spark.read.parquet(f"{path}/segments").where((F.col("part") == part) & (F.col("seq") == seq)).first()
    return Segment(bytes(row["segment"]), _dictionary(spark, path)).ids(slot).tolist()
