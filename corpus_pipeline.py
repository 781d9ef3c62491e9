"""Five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and returns a frame; all but the
last keep the columns of documents. Null and empty texts have no language and go in the first stage; each stage takes them
all the same, as its operator's module states, and gives no rows for no rows.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import language, packing, pii, repeats, simhash_copies
from kinmatch.llm.common import read_table, shared_folder
from kinmatch.llm.queries import pii_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go."""
    return language.with_language(docs, language.fit_languages(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of texts whose five-word shingles have a similarity of 0.8 or more, one with the smallest id stays.

    SimHash probes link the nearest copies, an exact join the rest. Rows are told apart by their texts, not their ids: of
    a class with null ids only, one stays; of unlike texts under one id, each goes or stays by its own class.
    """
    return simhash_copies.first_copies(docs, similarity=0.8, words_per_shingle=5)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that also start earlier go from the texts."""
    return repeats.without_repeats(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms of their format."""
    return pii.pseudonymise(docs, pii_key(spark), counts=False)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), 2048)


STAGES = [("language_id", language_id), ("simhash_near_dedup", simhash_near_dedup), ("suffix_dedup", suffix_dedup), ("pseudonyms", pseudonyms), ("best_fit_packing", best_fit_packing)]

#: SQL has no expression for the stages; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
