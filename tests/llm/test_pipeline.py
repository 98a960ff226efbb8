"""The pipeline's stages one after another, each held to a brute-force version on its own input."""

import random

import public_tokenizers
import sentencepiece
from test_minhash import brute

import corpus_pipeline
from tarn.llm import mixing, pii, quality, registry
from tarn.sources import scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def tables(spark, path):
    rng = random.Random(3)
    words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(80)]
    docs, labels = [], []
    for i in range(240):
        t = [rng.choice(words) for _ in range(rng.randint(12, 50))]
        if i % 6 == 0:
            t = [w.upper() + "$$$" for w in t]
        elif i % 10 == 1 and i > 20:
            t = docs[i - 20][1].split()[:-1] + ["edited"]
        elif i % 10 == 3:
            t[3] = "27.65.93.188"
        docs.append((i, " ".join(t), rng.choice(["en", "de"]), f"src{i % 3}", len(t)))
        labels.append((i, int(i % 6 > 0), 0))
    docs += [docs[7], (None, "a text without an id of its own", "en", "src1", 1), (900, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")


def test_each_stage_on_its_own_input(spark, tmp_path):
    path = str(tmp_path)
    tables(spark, path)
    docs = spark.read.parquet(f"{path}/documents.parquet")
    assert [n.rsplit("_", 1)[1] for n, _ in corpus_pipeline.STAGES] == ["9", "7", "4", "10", "5"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        labels = spark.read.parquet(f"{path}/labels.parquet")
        expected = {r["doc_id"] for r in quality.classify(docs, labels).collect() if r["kept"]} if name.endswith("_9") else None
        copies = mixing.mix_documents(docs, corpus_pipeline.SHARE, corpus_pipeline.EPOCHS).collect() if name.endswith("_10") else None
        docs = scratch(stage(spark, docs, path), name)
        after = [tuple(r) for r in docs.collect()]
        seen[name[-2:].strip("_")] = (before, after)
        if not name.endswith("_5"):
            assert docs.columns == COLUMNS
        if expected is not None:
            assert {r[0] for r in after} == expected and not any("$$$" in (r[1] or "") for r in after)
            assert set(range(240)) - expected == {i for i in range(240) if i % 6 == 0}
        if name.endswith("_7"):
            kept = {k for k, _, _, stays in brute([(r[0], r[1]) for r in before]) if stays}
            assert {r[0] for r in after} == kept and len(after) == len(kept) < len(before)
        if name.endswith("_4"):
            assert len(after) == len(before) and not any("27.65.93.188" in (r[1] or "") for r in after)
            assert {r[0]: r[1] for r in before if "27.65" not in (r[1] or "")}.items() <= {r[0]: r[1] for r in after}.items()
        if copies is not None:
            assert sorted(str(r[0]) for r in after) == sorted(str(r["doc_id"]) for r in copies for _ in range(r["copies"])) and len(after) < len(before)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = {r[0]: r[1] for r in seen["5"][0]}
    assert {r["doc_id"]: r["ids"] for r in docs.collect()} == {k: [1, *library.encode(t or ""), 2] for k, t in before.items()}
    assert sorted(map(str, corpus_pipeline.run(spark, path).drop("ids").collect())) == sorted(map(str, docs.drop("ids").collect()))
    assert registry.PII_KEY and pii.PATTERN


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    assert corpus_pipeline.run(spark, path).collect() == []
