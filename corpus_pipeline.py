"""From raw documents to token ids: five stages, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents, whatever else stands in them.

Defined cases, in all stages: an empty table gives an empty table; null and empty texts go in the first stage, and stay as they are where
a later stage gets them; rows that share a doc_id, or have none, are judged by their texts; extra columns of any name keep their values; texts are read whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from warpline.llm import bpe, decontaminate, language, simhash, suffixdedup
from warpline.llm.common import shared_dir

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language (null, empty, no letter) go; all others stay as they are."""
    return language.accept(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    return simhash.keep_one_similar(docs, shingle=5, similarity=0.8)


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Text that lies in a repeated string of 200 bytes goes; documents keep the rest."""
    return suffixdedup.clean(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, or 13 words in a row of it with at most two replaced, go; an empty benchmark drops none."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids, with digests of the ids and of the bytes decoded from them."""
    return bpe.round_trip(docs, RANKS, with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", drop_repeated_strings),
    ("decontamination", drop_benchmark_leaks),
    ("byte_bpe", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each one's rows lie in a folder of their own in the shared folder, where a lost executor finds them again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_dir(spark)
    for k, (name, stage) in enumerate(STAGES):
        path = f"{base}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
