"""Queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from warpline.llm import alignment, bpe, decontaminate, hardneg, hmm, language, lpt, media, rans, simhash, sql, substrings, suffixdedup, urlrules
from warpline.llm.common import materialise

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE_A = public_tokenizers.path("byte_bpe_50k.json")
PIECE_B = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, freq = rans.write_ids(read(spark, sf_dir, "documents"), WORD_BPE, end_id=1, vocabulary=49408)
    return rans.read_digest(blocks, freq)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.deduplicate(read(spark, sf_dir, "documents"), window=200)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read(spark, sf_dir, "documents"), window=20).drop("n_spans")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    return urlrules.match(read(spark, sf_dir, "pages"), rules)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), BYTE_BPE)


def op6_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe_texts(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=4, radius=4)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpt.place(read(spark, sf_dir, "documents"), shards=40)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hardneg.from_embeddings(read(spark, sf_dir, "embeddings"))
    return hardneg.mine(rows, F.col("id") % 50 == 0, positives=5, negatives=3, low=50, high=95)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(materialise(alignment.align(read(spark, sf_dir, "documents"), BYTE_BPE_A, PIECE_B)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_token_ids, op2_suffix_dedup, op3_substring_dedup, op4_url_rules, op5_byte_bpe, op6_hmm, op7_language, op8_media, op9_simhash, op10_decontamination, op11_lpt_shards, op12_hard_negatives, op13_token_alignment, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_suffix_dedup": sql.OP2, "op3_substring_dedup": sql.OP3, "op4_url_rules": sql.OP4, "op10_decontamination": sql.OP10, "op12_hard_negatives": sql.OP12}
