"""A corpus pipeline: quality, near duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tarn.llm import minhash, mixing, pii, piece, quality, registry
from tarn.sources import read_table, scratch

#: The mixture's budget, as a share of what is left, and its sources' weights. No document is repeated.
SHARE, EPOCHS = 0.9, 1
#: The variable of the driver's environment that holds the secret of the pseudonyms; without it, the demonstration's.
SECRET = "TARN_PII_SECRET"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose importance weight is that of good text; labels come from the table of that name."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each group of near duplicates, and all other documents; repeated rows once."""
    return minhash.one_each(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms of its format."""
    return pii.pseudonymize(docs, os.environ.get(SECRET, registry.PII_KEY))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their share of the token budget."""
    return mixing.Mix(docs, mixing.document_levels(), mixing.WEIGHTS, SHARE, EPOCHS, seed=29).apply(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, with their digests and those of the decoded text."""
    return piece.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_9", good_quality),
    ("near_dedup_7", one_of_each_group),
    ("pii_4", pseudonyms),
    ("mixing_10", mixture),
    ("pieces_5", tokens),
]


#: The quality model, MinHash components, keyed permutations and pieces are not SQL; tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
