"""Quality rules and a learned verdict, in DataFrame functions alone.

Rules count words, symbols, repeated lines and words in repeated windows of eight. The verdict is a hashed n-gram
log-likelihood ratio: word n-grams fall into a fixed number of buckets, one multinomial over buckets is counted on
trusted documents and one on the whole corpus, both smoothed by adding one, and a text's score is the mean over its
n-grams of the logarithm of the ratio. A document is kept if it passes the rules and scores no less than a fixed
threshold. Counts are summed in the tasks before they are shuffled, by bucket; the weights, one a bucket, are all that
is sent back to the tasks.

Defined results: null and blank texts have no words, fail the rules and are not kept. A text of one word has one
n-gram of order one. Without trusted documents every weight is what smoothing gives it. Rows that share a doc_id each
give a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
#: Trusted documents that the target multinomial is counted on, in expectation; those with the smallest hashes.
TRUSTED_DOCS = 20_000
#: Least mean log-likelihood ratio (nats an n-gram) of a document that is kept.
LEAST_SCORE = -0.09
WINDOW = 8


def _words() -> Column:
    trimmed = F.btrim(F.coalesce("text", F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+", -1)).otherwise(F.array().cast("array<string>"))


def _joined(hashes: str, apart: int) -> Column:
    """Hashes of runs of words twice as long, from those of runs that begin so many words apart; none if there are too few."""
    h = F.col(hashes)
    return F.when(F.size(h) > apart, F.zip_with(F.slice(h, F.lit(1), F.greatest(F.size(h) - apart, F.lit(0))), F.slice(h, F.lit(apart + 1), F.greatest(F.size(h) - apart, F.lit(0))), lambda x, y: F.xxhash64(x, y))).otherwise(F.array().cast("array<bigint>"))


def _bucket(x: Column) -> Column:
    return x.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def bucket_weights(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """Log-likelihood ratio of every bucket. docs: doc_id, text; trusted: doc_id of trusted documents."""
    n = trusted.count()
    place = F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1_000_003)) / 1_000_003
    sample = trusted.select("doc_id").distinct().where(place < min(1.0, TRUSTED_DOCS / max(n, 1))).withColumn("target", F.lit(1))
    marked = docs.join(F.broadcast(sample), "doc_id", "left").select("target", "text")
    flagged = marked.select("target", F.transform(_words(), lambda w: F.xxhash64(w)).alias("h1")).withColumn("h2", _joined("h1", 1)).select("target", F.concat("h1", "h2").alias("h"))
    # outer: else a filter on the arrays' sizes is inferred and evaluates them once more
    grams = flagged.select("target", F.explode_outer("h").alias("x")).select("target", _bucket(F.col("x")).alias("bucket"))
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("target").alias("target")).where("bucket is not null").collect()
    raw, target = [1] * BUCKETS, [1] * BUCKETS
    for row in counts:
        raw[row.bucket] += row.raw
        target[row.bucket] += row.target
    raw_all, target_all = math.log(sum(raw)), math.log(sum(target))
    return [math.log(t) - target_all - math.log(r) + raw_all for t, r in zip(target, raw)]


def rules(docs: DataFrame, weights: list[float], id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """The result of quality() with given weights."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0)
    table = F.split(F.lit(",".join(f"{x:.12g}" for x in weights)), ",").cast("array<double>")
    base = rows.select("doc_id", "text", _words().alias("words"), lines.alias("lines")).select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("bigint"), lambda acc, w: acc + F.char_length(w)).alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines"]
    runs = base.withColumn("h2", _joined("h1", 1)).withColumn("h4", _joined("h2", 2)).withColumn("h8", _joined("h4", 4))
    total = sum((F.aggregate(x, F.lit(0.0), lambda acc, b: acc + F.get(table, _bucket(b))) for x in ("h1", "h2")), F.lit(0.0))
    wide = runs.select(*counts, (total / F.greatest(F.size("h1") + F.size("h2"), F.lit(1))).alias("score"), F.col("h8").alias("windows"))
    # positions in order of their windows' hashes, only where some window repeats
    by_hash = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))).otherwise(F.array().cast("array<struct<x:bigint,i:int>>"))
    scored = wide.select(*counts, "score", by_hash.alias("by_hash"))
    last = F.size("by_hash")
    s = F.col("by_hash")
    twice = F.filter(F.transform(s, lambda e, k: F.when(((k > 0) & (F.get(s, k - 1)["x"] == e["x"])) | ((k < last - 1) & (F.get(s, k + 1)["x"] == e["x"])), e["i"])), lambda i: i.isNotNull())
    starts = scored.withColumn("starts", F.array_sort(twice)).drop("by_hash")
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("words")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["words"] + (i + WINDOW - F.greatest(i, acc["end"]))).cast("bigint").alias("words")),
        lambda acc: acc["words"],
    )
    counted = starts.withColumn("n_repeat_words", covered).drop("starts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least_score)).select(*counts, "n_repeat_words", "base_failed", "kept", "score")


def quality(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """Counts, verdict of the rules, verdict of the rules and the score, and the score of every document."""
    plain = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rules(docs, bucket_weights(plain, trusted), id_col, text_col, least_score)
