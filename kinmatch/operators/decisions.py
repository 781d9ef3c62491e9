"""From scored pairs to matches: thresholds, margins, exclusive owners, id lists and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(scored: DataFrame, threshold: float, margin: float) -> DataFrame:
    """scored (country, q, c, p): p at least the threshold and at most margin below the query's best.

    The threshold goes first: a query whose best is below it has no eligible pair, and others keep their best.
    """
    best = F.max("p").over(Window.partitionBy("country", "q"))
    return scored.where(F.col("p") >= threshold).withColumn("best", best).where(F.col("p") >= F.col("best") - margin).drop("best")


def decide(scored: DataFrame, threshold: float, margin: float, exclusive: bool = True) -> DataFrame:
    """(country, q, c): with exclusive, each candidate goes to the query with the largest p, then the smallest id."""
    kept = eligible(scored, threshold, margin)
    if exclusive:
        kept = kept.withColumn("r", F.row_number().over(Window.partitionBy("country", "c").orderBy(F.desc("p"), "q"))).where("r = 1")
    return kept.select("country", "q", "c")


def decide_grid(scored: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """(threshold, margin, exclusive, country, q, c) for all settings at once."""
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(float(m)).alias("margin"), F.lit(e).alias("exclusive")) for t in thresholds for m in margins for e in (False, True)])
    best = F.max("p").over(Window.partitionBy("country", "q"))
    rows = scored.where(F.col("p") >= min(thresholds)).withColumn("best", best).withColumn("s", F.explode(F.filter(grid, lambda s: (F.col("p") >= s["threshold"]) & (F.col("p") >= F.col("best") - s["margin"]))))
    owner = F.row_number().over(Window.partitionBy("s", "country", "c").orderBy(F.desc("p"), "q"))
    return rows.withColumn("r", owner).where(~F.col("s.exclusive") | (F.col("r") == 1)).select("s.threshold", "s.margin", "s.exclusive", "country", "q", "c")


def id_lists(pairs: DataFrame) -> DataFrame:
    """(q, matched): candidates of each query in order of their ids."""
    return pairs.groupBy("q").agg(F.array_sort(F.collect_list("c")).alias("matched"))


def complete(queries: DataFrame, lists: DataFrame) -> DataFrame:
    """Every query, with an empty list where it has none."""
    return queries.join(lists, "q", "left").withColumn("matched", F.coalesce("matched", F.array().cast(lists.schema["matched"].dataType)))


def pair_violations(scored: DataFrame) -> DataFrame:
    """(rule, n): pairs that occur twice, and probabilities outside 0 to 1 or not finite."""
    twice = scored.groupBy("country", "q", "c").agg(F.count("*").alias("k")).where("k > 1").agg(F.lit("duplicate_pair").alias("rule"), F.count("*").alias("n"))
    outside = scored.where("p is null or isnan(p) or p < 0 or p > 1").agg(F.lit("p_outside").alias("rule"), F.count("*").alias("n"))
    return twice.union(outside)


def audit(queries: DataFrame, candidates: DataFrame, matches: DataFrame, corpus: DataFrame | None = None, expected: int | None = None) -> DataFrame:
    """(rule, n) of every rule on id lists. queries (q); candidates, matches (q, ids); corpus (c)."""
    rules = {
        "duplicate_candidate_row": candidates.groupBy("q").agg(F.count("*").alias("k")).where("k > 1"),
        "duplicate_match_row": matches.groupBy("q").agg(F.count("*").alias("k")).where("k > 1"),
        "missing_candidate_row": queries.join(candidates, "q", "left_anti"),
        "missing_match_row": queries.join(matches, "q", "left_anti"),
        "unknown_query": candidates.select("q").union(matches.select("q")).distinct().join(queries, "q", "left_anti"),
        "duplicate_in_list": candidates.union(matches).where(F.size(F.array_distinct("ids")) < F.size("ids")),
        "match_not_candidate": matches.join(candidates.withColumnRenamed("ids", "listed"), "q").where(F.size(F.array_except("ids", "listed")) > 0),
        "owned_twice": matches.select("q", F.explode("ids").alias("c")).groupBy("c").agg(F.count_distinct("q").alias("k")).where("k > 1"),
    }
    if corpus is not None:
        rules["unknown_candidate"] = candidates.select(F.explode("ids").alias("c")).distinct().join(corpus, "c", "left_anti")
    out = None
    for rule, bad in rules.items():
        row = bad.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"))
        out = row if out is None else out.union(row)
    if expected is not None:
        out = out.union(matches.agg(F.lit("row_count").alias("rule"), F.abs(F.count("*") - expected).alias("n")))
    return out


def list_violations(rows: DataFrame, prefixes: tuple[str, ...] = ("S2-", "S3-"), own: str = "S1-") -> DataFrame:
    """(q, rule) of raw rows (q, list), where list is a comma-separated string: what the submission rules forbid."""
    ids = F.when(F.col("list") == "", F.array().cast("array<string>")).otherwise(F.split("list", ","))
    known = F.lit(False)
    rows = rows.withColumn("ids", ids)
    right = lambda x: F.greatest(*[x.startswith(p) for p in prefixes]) if len(prefixes) > 1 else x.startswith(prefixes[0])
    rules = {
        "empty_id": F.exists("ids", lambda x: F.btrim(x) == ""), "padded_id": F.exists("ids", lambda x: F.btrim(x) != x), "self_match": F.exists("ids", lambda x: x.startswith(own)),
        "wrong_prefix": F.exists("ids", lambda x: ~right(x) & ~x.startswith(own)), "duplicate_id": F.size(F.array_distinct("ids")) < F.size("ids"), "wrong_query_prefix": ~F.col("q").startswith(own),
    }
    found = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    return rows.where(~known).select("q", F.explode(found).alias("rule"))


def sidecar_difference(lists: DataFrame, sidecar: DataFrame) -> DataFrame:
    """(problem, n): pairs of the lists (q, ids) against the sidecar (q, c)."""
    listed = lists.select("q", F.explode("ids").alias("c")).groupBy("q", "c").agg(F.count("*").alias("n_listed"))
    told = sidecar.groupBy("q", "c").agg(F.count("*").alias("n_told"))
    both = listed.join(told, ["q", "c"], "full_outer")
    problem = F.when(F.col("n_told").isNull(), "missing").when(F.col("n_listed").isNull(), "extra").when((F.col("n_told") > 1) | (F.col("n_listed") > 1), "duplicate").otherwise("equal")
    return both.groupBy(problem.alias("problem")).agg(F.count("*").alias("n"))
