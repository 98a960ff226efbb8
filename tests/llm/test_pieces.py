import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from tarn.llm.piece import PieceEncoder, encode_documents

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def random_texts(n):
    rng = random.Random(5)
    return ["".join(rng.choice(["a", "b", " ", "▁", "é", "\n", "😀", "the", "ing", "1", "  ", "　", "."]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_whole_texts_are_encoded_as_the_library_does(library):
    coder = PieceEncoder(MODEL)
    texts = [*random_texts(3000), "a" * 5000, "the" + " " * 50 + "x", "", " ", "▁▁", "x▁▁y"]
    for t, ids in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t), t


def test_heap_and_arrays_agree_and_whole_text_segments_too():
    coder = PieceEncoder(MODEL, check=False)
    segments = sorted({s for t in random_texts(500) for s in coder.segments(t)})
    assert [np.asarray(coder.agenda(s), "<u4").tobytes() for s in segments] == coder.agendas(segments)
    whole = PieceEncoder(MODEL, check=False)
    whole.split = False
    texts = random_texts(200)
    assert coder.encode(texts) == whole.encode(texts)


def test_a_difference_is_an_error():
    coder = PieceEncoder(MODEL)
    coder.agendas = lambda segments: [b"\x07\x00\x00\x00" for _ in segments]
    with pytest.raises(ValueError, match="differ"):
        coder.encode(["some words"])


def test_odd_documents(odd, library):
    rows = encode_documents(odd, MODEL, with_ids=True).collect()
    assert len(rows) == odd.count()
    texts = sorted(((r["doc_id"], r["text"]) for r in odd.collect()), key=str)
    for (key, text), r in zip(texts, sorted(rows, key=lambda r: (str((r["doc_id"], dict((k, t) for k, t in texts).get(r["doc_id"]))))), strict=True):
        if key is None:
            continue
        ids = [1, *library.encode(text or ""), 2]
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty(docs):
    assert encode_documents(docs([]), MODEL).collect() == []
