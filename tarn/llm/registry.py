"""The registered queries of this subpackage, each one operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import ann, chat, hamming, minhash, mixing, pii, piece, quality, sharding, tokenfiles
from tarn.sources import read_table, scratch_dir


def op1_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=40)


def op2_multi_index_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = hamming.sign_codes(read_table(spark, sf_dir, "embeddings"))
    return hamming.nearest_codes(codes, F.col("vec_id") % 100 == 0, k=10)


def op3_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(read_table(spark, sf_dir, "conversations"))


#: The key of the registered query; a user's own is secret.
PII_KEY = "tarn-demonstration-key"


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymize(docs, PII_KEY, count="n_replaced")


def op5_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece.encode_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_vectors(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "tokens")
    tokenfiles.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return tokenfiles.read_tokens(spark, path)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), budget=quality.BUDGET)


def op10_hierarchical_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lpt_sharding, op2_multi_index_hamming, op3_transcript_hmm, op4_feistel_pseudonyms, op5_piece_round_trip, op6_ivf_pq, op7_circulant_minhash, op8_token_files, op9_importance_resampling, op10_hierarchical_mixing)}


#: Nearest codes by comparing the signs of all pairs of a query and a row.
HAMMING_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding[1:64], lambda x: x > 0) AS s FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(len(list_filter(list_zip(q.s, c.s), lambda z: z[1] <> z[2])) AS INTEGER) AS distance
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) <= 10
"""


#: All pairs that share a shingle, their exact similarity, and what is reachable over the links.
NEAR_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON least.a = doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_circulant_minhash": NEAR_SQL, "op2_multi_index_hamming": HAMMING_SQL, "op10_hierarchical_mixing": mixing.mix_sql()}
