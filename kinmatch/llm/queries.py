"""The queries of this subpackage: each applies an operator to its whole table and returns its full result.

None has an oracle in SQL: the automata, graphs, suffix orders, fingerprints and packings are iterative or need hashes
and vocabularies that SQL lacks. tests/llm/ holds each against a brute-force version.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm import ann, bpe, language, lm, packing, pii, quality, repeats, simhash
from kinmatch.llm import tokens as token_counting
from kinmatch.llm.common import read_table

def pii_key(spark: SparkSession) -> str:
    """kinmatch.pii.key; where it is not set, a random key that is set for the rest of the session."""
    if not spark.conf.get("kinmatch.pii.key", ""):
        spark.conf.set("kinmatch.pii.key", secrets.token_hex(32))
    return spark.conf.get("kinmatch.pii.key")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counting.token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats_report(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.quality(read_table(spark, sf_dir, "documents"), trusted)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = "crc32(cast(doc_id as string)) % 3 = 1"
    model = language.fit_languages(docs.where(f"not {held_out}"))
    return language.predict_languages(docs, model).select("doc_id", F.expr(held_out).alias("held_out"), "lang_pred", "score")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op8_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.language_scores(read_table(spark, sf_dir, "documents"))


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 2048)


def op10_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(read_table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_nearest_vectors, op3_suffix_dedup, op4_quality_rules, op5_language_id, op6_bpe_round_trip, op7_simhash, op8_lm_scores, op9_pack, op10_pseudonyms)}
ORACLE_SQL: dict[str, str] = {}
