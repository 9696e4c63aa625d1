"""From raw documents to token ids: quality, toxicity, near duplicates, mixing, byte-level BPE.

Every stage works on all rows that the one before kept and is written to the shared folder
before the next begins, so a lost executor repeats part of one stage at most.

Defined cases are those of the operators.  The first three stages keep rows as they are, with all their
columns; documents that repeat an id or have none are judged one by one, also as duplicates; mixing
repeats rows whose source is short of its target; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rosterloom.llm import bpe, minhash, mixing, quality, toxicity
from rosterloom.llm.common import forget, landed, table

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, table(spark, sf_dir, "labels"))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def mixed_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids themselves (little-endian unsigned 32-bit integers)."""
    import public_tokenizers

    return bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN, keep_ids=True)


STAGES = [
    ("quality", good_quality),
    ("toxicity", not_toxic),
    ("near_duplicates", without_near_duplicates),
    ("mixing", mixed_to_weights),
    ("encoding", encoded),
]

# No stage's decision can be told in SQL (two learned models, hashes of a library, BPE merges).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            forget(before)  # the next stage's copy is written
        before = docs
    return docs
