"""The corpus pipeline: language ID, exact and near deduplication, removal of repeated passages, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallow.llm.common import materialize, table
from tallow.llm.exact_dedup import drop_exact_copies
from tallow.llm.language import drop_unidentified
from tallow.llm.packing import pack
from tallow.llm.simhash import drop_near_copies
from tallow.llm.suffix_dedup import drop_repeats

#: Words of a shingle where near copies are sought.
NEAR_SHINGLE = 5
#: Words that a packing worker keeps encoded: fewer than alone, as it shares its executor with the other stages' memory.
PACKING_WORDS = 100_000
#: Bytes of a repeat that goes, so that passages of 50 words are covered, and of the grams that anchor it.
REPEAT_BYTES, REPEAT_GRAM = 240, 32


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, shingle=NEAR_SHINGLE)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs, length=REPEAT_BYTES, gram=REPEAT_GRAM, keep_first=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=PACKING_WORDS)


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("suffix_dedup", repeats), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Rank profiles, fingerprints and tokens are not expressible in SQL: tests hold the stages against brute force.
ORACLE_SQL = None
