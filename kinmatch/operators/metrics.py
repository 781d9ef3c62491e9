"""Macro F0.5, blocking quality, recall curves, areas under curves, bootstrap intervals and drift."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f_half(p: Column, r: Column) -> Column:
    return F.when(0.25 * p + r > 0, 1.25 * p * r / (0.25 * p + r)).otherwise(0.0)


def entity_scores(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """truth (country, q, matched) against predicted (q, predicted): hits and F0.5 of every truth query."""
    both = truth.join(predicted, "q", "left").withColumn("predicted", F.coalesce("predicted", F.array().cast(truth.schema["matched"].dataType)))
    tp, n_p, n_t = F.size(F.array_intersect("matched", "predicted")), F.size(F.array_distinct("predicted")), F.size(F.array_distinct("matched"))
    score = F.when(n_t == 0, F.when(n_p == 0, 1.0).otherwise(0.0)).when((n_p == 0) | (tp == 0), 0.0).otherwise(f_half(tp / n_p, tp / n_t))
    return both.select("country", "q", tp.alias("tp"), n_p.alias("n_p"), n_t.alias("n_t"), score.alias("score"))


def macro_report(scores: DataFrame) -> DataFrame:
    """By country and, with the name ALL, over everything."""
    tp, p, t = F.sum("tp"), F.sum("n_p"), F.sum("n_t")
    return scores.rollup("country").agg(F.count("*").alias("entities"), F.avg("score").alias("macro_f"), F.avg(F.when(F.col("n_t") == 0, F.col("score"))).alias("singleton_accuracy"), F.avg(F.when(F.col("n_t") > 0, F.col("score"))).alias("matched_f"), F.when(p > 0, tp / p).alias("micro_precision"), F.when(t > 0, tp / t).alias("micro_recall"), tp.alias("tp"), (p - tp).alias("fp"), (t - tp).alias("fn")).withColumn("country", F.coalesce("country", F.lit("ALL")))


def blocking_quality(truth: DataFrame, lists: DataFrame, corpus_sizes: DataFrame) -> DataFrame:
    """Recall of candidate lists (q, ids); queries without matches count for sizes only. corpus_sizes (country, corpus)."""
    both = truth.join(lists, "q", "left").join(corpus_sizes, "country").withColumn("ids", F.coalesce("ids", F.array().cast(truth.schema["matched"].dataType)))
    n_t, n_c, hit = F.size("matched"), F.size("ids"), F.size(F.array_intersect("matched", "ids"))
    rows = both.select("country", "corpus", n_t.alias("t"), n_c.alias("k"), hit.alias("hit"))
    has = F.col("t") > 0
    return rows.rollup("country").agg(F.count("*").alias("entities"), F.avg(F.when(has, F.col("hit") / F.col("t"))).alias("macro_recall"), (F.sum("hit") / F.sum("t")).alias("micro_recall"), F.avg("k").alias("avg_list"), F.max("k").alias("max_list"), (1 - F.avg(F.col("k") / F.col("corpus"))).alias("reduction"), F.count_if(has & (F.col("hit") == 0)).alias("all_missed"), F.count_if(~has).alias("singletons")).withColumn("country", F.coalesce("country", F.lit("ALL")))


def recall_at(ranked: DataFrame, ks: list[int]) -> DataFrame:
    """ranked (rank, label): hits within each k over all positives."""
    return ranked.agg(*[(F.sum(F.when(F.col("rank") <= k, F.col("label")).otherwise(0)) / F.sum("label")).alias(f"r{k}") for k in ks])


def depth_recall(pool: DataFrame, depths: list[int], k: int, first: str = "rrf", then: str = "score") -> DataFrame:
    """(depth, recall): cut each query's pool (country, q, c, label) by `first`, order by `then`, hits within k over all positives."""
    by_first = F.row_number().over(Window.partitionBy("country", "q").orderBy(F.desc(first), "c"))
    rows = pool.withColumn("r1", by_first).withColumn("depth", F.explode(F.filter(F.array(*map(F.lit, depths)), lambda d: d >= F.col("r1"))))
    again = rows.withColumn("r2", F.row_number().over(Window.partitionBy("depth", "country", "q").orderBy(F.desc(then), "c")))
    hits = again.groupBy("depth").agg(F.sum(F.when(F.col("r2") <= k, F.col("label")).otherwise(0)).alias("hits"))
    positives = pool.agg(F.sum("label").alias("positives")).withColumn("one", F.lit(1))
    return hits.withColumn("one", F.lit(1)).join(positives, "one").select("depth", (F.col("hits") / F.col("positives")).alias("recall"))


def auc(rows: DataFrame, value: str, label: str = "label") -> DataFrame:
    """One row (auc, neutral): ties count half. Values are aggregated before they are ranked."""
    by_value = rows.groupBy(F.col(value).alias("v")).agg(F.sum(label).alias("pos"), F.sum(1 - F.col(label)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    area = F.sum("w") / (F.sum("pos") * F.sum("neg"))
    return by_value.withColumn("w", F.col("pos") * (below + F.col("neg") / 2)).agg(area.alias("auc")).withColumn("neutral", F.greatest("auc", 1 - F.col("auc")))


def average_precision(rows: DataFrame, value: str, label: str = "label") -> DataFrame:
    """Sum over distinct values, highest first, of precision times the gain in recall."""
    by_value = rows.groupBy(F.col(value).alias("v")).agg(F.sum(label).alias("pos"), F.count("*").alias("n"))
    down = Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    return by_value.withColumn("precision", F.sum("pos").over(down) / F.sum("n").over(down)).agg((F.sum(F.col("precision") * F.col("pos")) / F.sum("pos")).alias("average_precision"))


def bootstrap(scores: DataFrame, replicates: int = 1000, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """One row (point, ci_low, ci_high) for scores (country, q, score), resampled within countries at their own sizes.

    Drawing n of n entities draws how often each distinct score comes up, a multinomial over the counts of scores; so a
    country is resampled from its counts, and no task holds its entities. With few entities or many the draws are alike.
    """
    if replicates < 1:
        raise ValueError("at least one replicate is needed")
    counts = scores.groupBy("country", "score").agg(F.count("*").alias("n"))

    def draw(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("score")
        n, total = part["n"].to_numpy(np.int64), int(part["n"].sum())
        own = np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(str(key[0]).encode(), digest_size=4).digest(), "big")])
        return pd.DataFrame({"rep": np.arange(replicates), "total": own.multinomial(total, n / total, size=replicates) @ part["score"].to_numpy(), "n": total})

    sums = counts.groupBy("country").applyInPandas(draw, "rep int, total double, n bigint")
    means = sums.groupBy("rep").agg((F.sum("total") / F.sum("n")).alias("m"))
    ends = means.agg(F.percentile("m", F.lit(alpha / 2)).alias("ci_low"), F.percentile("m", F.lit(1 - alpha / 2)).alias("ci_high")).withColumn("one", F.lit(1))
    return scores.agg(F.avg("score").alias("point")).withColumn("one", F.lit(1)).join(ends, "one").drop("one")


def drift(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """One row on list sizes of candidates (q, ids) and matches (q, ids)."""
    n = F.size("ids")
    a = candidates.agg(F.count("*").alias("n"), F.avg(n).alias("mean_candidates"), F.percentile(n, F.lit(0.5)).alias("p50"), F.percentile(n, F.lit(0.9)).alias("p90"), F.percentile(n, F.lit(0.99)).alias("p99"), F.avg((n == 0).cast("int")).alias("empty_rate")).withColumn("one", F.lit(1))
    b = matches.agg(F.avg((n == 0).cast("int")).alias("singleton_rate"), F.avg(n).alias("mean_matches")).withColumn("one", F.lit(1))
    return a.join(b, "one").drop("one")
