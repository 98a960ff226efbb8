import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import zstandard
from tokenizers import Tokenizer

from tarn.llm import tokenfiles
from tarn.llm.tokenfiles import Segment, TokenEncoder, pack, read_document, read_tokens, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_pieces_give_the_librarys_ids():
    rng = random.Random(3)
    parts = ["a", "b", " ", " ", "\n", "'s", "é", "1", "!", ".", " ", "　", "\t", "\r", "\x1c", "\x85", "the", "\x0b", ",", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(20_000)]
    coder, library = TokenEncoder(PATH), Tokenizer.from_file(PATH)
    want = library.encode_batch(texts, add_special_tokens=False)
    assert all(np.frombuffer(g, "<u2").tolist() == w.ids for g, w in zip(coder.encode(texts), want, strict=True))


def test_a_segment_opens_one_document():
    dictionary = zstandard.train_dictionary(512, [bytes([i % 7, 0] * 40 + [i % 5, 0] * 9) for i in range(400)]).as_bytes()
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (0, 3, 500)]
    data = pack([5, None, -9], ids, 2, dictionary)
    s = Segment(data, dictionary)
    assert s.doc_ids == [5, None, -9] and [s.ids(k).tobytes() for k in range(3)] == ids
    with pytest.raises(ValueError, match="another dictionary"):
        Segment(data, b"")
    with pytest.raises(ValueError, match="format"):
        Segment(b"XXXX" + data[4:], dictionary)


def check(spark, table, path):
    write_tokens(table, path, PATH, end_id=2)
    library = Tokenizer.from_file(PATH)
    rows = read_tokens(spark, path).orderBy("part", "seq", "slot").collect()
    texts = table.select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    keys = [r["doc_id"] for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k))
    at = 0
    want = {}
    for r in texts:
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = {}
    for r in rows:
        assert r["start"] == at
        at += r["n_tokens"]
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    return rows


def test_odd_documents(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "SEGMENT_DOCS", 4)
    path = str(tmp_path / "tokens")
    rows = check(spark, odd, path)
    library = Tokenizer.from_file(PATH)
    one = next(r for r in rows if r["doc_id"] == 10)
    assert read_document(spark, path, one["part"], one["seq"], one["slot"]) == [*library.encode("a  b\n\n c \r\n d").ids, 2]


def test_many_documents_share_a_dictionary(spark, docs, tmp_path):
    rng = random.Random(2)
    words = [f"word{i}" for i in range(50)]
    path = str(tmp_path / "tokens")
    check(spark, docs([" ".join(rng.choice(words) for _ in range(40)) for _ in range(600)]), path)
    assert spark.read.parquet(f"{path}/dictionary").first()["hash"]


def test_empty(spark, docs, tmp_path):
    assert check(spark, docs([]), str(tmp_path / "tokens")) == []
