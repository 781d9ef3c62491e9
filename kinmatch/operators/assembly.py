"""From pools of candidates to the lists that are handed in: the feature frame, the choice of a setting, merges and checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.operators import compare, decisions, metrics, pairs, similarity

# Thresholds and margins that a setting is chosen from, each with and without exclusive owners.
THRESHOLDS = (0.35, 0.50, 0.65, 0.75, 0.82, 0.88, 0.92, 0.95, 0.97, 0.985)
MARGINS = (0.0, 0.03, 0.07, 0.12, 0.20, 0.35, 1.0)
FEATURES = [*pairs.BASE, *pairs.CONTEXT]


def refuse(bad: DataFrame, what: str) -> None:
    """An error if there is a row, with up to five of them."""
    found = bad.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in found)}")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def non_finite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n): how many values of each column are null, not a number or infinite, where there are any."""
    counts = rows.agg(*[F.count_if(~finite(F.col(c).cast("double"))).alias(c) for c in columns])
    told = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")
    return counts.select(told).select("x.*").where("n > 0")


def corpus_of(sources: dict[str, DataFrame]) -> DataFrame:
    """The sources (country, id, ...) together, with the flag is_s3 and the name of the source."""
    out = None
    for name, rows in sources.items():
        rows = rows.withColumns({"source": F.lit(name), "is_s3": F.lit(1 if name.lower() in ("s3", "source3") else 0)})
        out = rows if out is None else out.unionByName(rows)
    return out


def id_collisions(sources: dict[str, DataFrame]) -> DataFrame:
    """(id, n): ids that more than one row or source has."""
    return corpus_of({k: x.select("country", "id") for k, x in sources.items()}).groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


def outside_country(candidates: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidates (country, q, c) that are not records of their country's corpus (country, id)."""
    return candidates.join(corpus.select("country", F.col("id").alias("c")), ["country", "c"], "left_anti").select("country", "q", "c")


def labelled(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """Candidates (q, c, ...) with label: 1 where the truth (q, matched) has the pair."""
    hits = truth.select("q", F.explode("matched").alias("c")).distinct().withColumn("label", F.lit(1))
    return candidates.join(hits, ["q", "c"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def of_queries(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows whose query is among queries (q)."""
    return rows.join(queries.select("q").distinct(), "q", "left_semi")


def ordered_queries(rows: DataFrame, most: int | None = None) -> DataFrame:
    """The distinct queries in order; with most, as a trial run asks for, the first so many."""
    out = rows.select("q").distinct().orderBy("q")
    return out.limit(most) if most is not None else out


def frame_records(rows: DataFrame, df: DataFrame, corpus: DataFrame, rare_fraction: float, *more: str) -> DataFrame:
    """What the features of a frame ask of records (country, id, name, address, more): texts, keys, rare tokens and weighed places."""
    keys = ["country", "id"]
    rare = pairs.rare_tokens(pairs.forms(rows), df, rare_fraction)
    places = pairs.location_weights(rows, df, corpus).select(*keys, F.map_keys("places").alias("places"), F.map_values("places").alias("place_weights"))
    return compare.records(rows, *more).join(rare.hint("shuffle_hash"), keys, "left").join(places.hint("shuffle_hash"), keys, "left")


def _frame(dealt: compare.Dealt) -> DataFrame:
    made = [x for x in FEATURES if x not in pairs.VALUES and x not in pairs.CONTEXT[:5]]
    return dealt.compared(made, pairs.VALUES, reverse=True).select("country", "q", "c", *FEATURES)


def feature_frame(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, score: str = "score", rare_fraction: float = 0.01) -> DataFrame:
    """(country, q, c and the 23 features) of candidates (country, q, c, rrf, n_hit, best_rank, is_s3, score).

    All candidates of a country must be there: ranks are among them. Records are cleaned once each. Rows with a feature
    that is not finite do not come out of here: the frame is checked by non_finite() where it is written.
    """
    df = pairs.address_df(pairs.forms(corpus))
    q, c = (frame_records(x, df, corpus, rare_fraction) for x in (queries, corpus))
    values = ["rrf", "n_hit", "best_rank", "is_s3"]
    return _frame(compare.given(candidates.select("country", "q", "c", *values, F.col(score).cast("double").alias("given_score")), [*values, "given_score"], q, c, lambda x: x["given_score"]))


def fused_feature_frame(queries: DataFrame, corpus: DataFrame, channels: list[similarity.Channel], digits: int = 9, rare_fraction: float = 0.01) -> DataFrame:
    """The frame of the candidates that the channels find in the corpus (country, id, name, address, is_s3), ranked by their rounded fused scores."""
    df = pairs.address_df(pairs.forms(corpus))
    q, c = frame_records(queries, df, corpus, rare_fraction), frame_records(corpus, df, corpus, rare_fraction, "is_s3")
    return _frame(compare.fused(queries, corpus, channels, q, c, lambda x: np.floor(x["rrf"] * 10.0**digits + 0.5) / 10.0**digits))


def setting_scores(scored: DataFrame, truth: DataFrame, thresholds=THRESHOLDS, margins=MARGINS) -> DataFrame:
    """(threshold, margin, exclusive, macro_f05) of every setting, over all queries of the truth (country, q, matched)."""
    taken = decisions.decide_grid(scored, list(thresholds), list(margins))
    keys = ["threshold", "margin", "exclusive"]
    hits = truth.select("q", F.explode("matched").alias("c")).distinct().withColumn("hit", F.lit(1))
    of_query = taken.join(hits, ["q", "c"], "left").groupBy(*keys, "q").agg(F.count("*").alias("n_p"), F.count("hit").alias("tp"))
    sizes = truth.select("q", F.size(F.array_distinct("matched")).alias("n_t"))
    p, r = F.col("tp") / F.col("n_p"), F.col("tp") / F.col("n_t")
    score = F.when((F.col("n_t") == 0) | (F.col("tp") == 0), 0.0).otherwise(metrics.f_half(p, r))
    # a query without predictions scores 1 if it has no match, else 0: known without a row for it
    total = truth.agg(F.count("*").alias("n"), F.count_if(F.size("matched") == 0).alias("singles")).withColumn("one", F.lit(1))
    sums = of_query.join(sizes, "q").withColumn("score", score).groupBy(*keys).agg(F.sum("score").alias("s"), F.count_if(F.col("n_t") == 0).alias("spoilt"))
    grid = scored.sparkSession.createDataFrame([(float(t), float(m), e) for t in thresholds for m in margins for e in (False, True)], "threshold double, margin double, exclusive boolean")
    every = grid.join(sums, keys, "left").withColumn("one", F.lit(1)).join(total, "one")
    return every.select(*keys, ((F.coalesce("s", F.lit(0.0)) + F.col("singles") - F.coalesce("spoilt", F.lit(0))) / F.col("n")).alias("macro_f05"))


def best_setting(scores: DataFrame) -> DataFrame:
    """The one row of the exclusive setting with the largest macro F0.5; of equals the least threshold, then margin."""
    return scores.where("exclusive").orderBy(F.desc("macro_f05"), "threshold", "margin").limit(1)


def entity_complete(rows: DataFrame, sample: DataFrame, entities: int) -> DataFrame:
    """All rows (q, ...) of the first so many queries, in order, of a sample of rows: a query's candidates are never cut."""
    return of_queries(rows, ordered_queries(sample, entities))


def merged(parts: list[DataFrame], key: str = "q") -> DataFrame:
    """All parts together; a key that is there twice is an error."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    refuse(out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1"), f"{key} more than once")
    return out


def zipped(candidates: DataFrame, matches: DataFrame) -> DataFrame:
    """(position, problem) where two files (position, q) do not have the same query at the same position."""
    left, right = candidates.select("position", F.col("q").alias("a")), matches.select("position", F.col("q").alias("b"))
    problem = F.when(F.col("a").isNull(), "missing candidate row").when(F.col("b").isNull(), "missing match row").when(F.col("a") != F.col("b"), "other query")
    return left.join(right, "position", "full_outer").select("position", problem.alias("problem")).where("problem is not null")


def assembled(queries: DataFrame, candidates: DataFrame, decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists (q, ids) of candidates and of matches for every query, empty where it has none, from pairs (q, c)."""
    lists = lambda rows: decisions.complete(queries.select("q"), decisions.id_lists(rows)).select("q", F.col("matched").alias("ids"))
    return lists(candidates), lists(decided)


def assembly_report(matches: DataFrame) -> DataFrame:
    """One row on matches (q, ids): entities, predicted singletons and their share, matched ids."""
    n = F.size("ids")
    return matches.agg(F.count("*").alias("entities"), F.count_if(n == 0).alias("predicted_singletons"), F.avg((n == 0).cast("int")).alias("singleton_rate"), F.sum(n).alias("matched_ids"))


def size_distribution(lists: DataFrame, full: int) -> DataFrame:
    """(size, n, share, is_full) of the lists (q, ids); full: the size that a list is cut at."""
    sizes = lists.groupBy(F.size("ids").alias("size")).agg(F.count("*").alias("n"))
    return sizes.withColumns({"share": F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), "is_full": F.col("size") == full})


def file_violations(lines: DataFrame, header: tuple[str, str], queries: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(rule, n, examples) of a file's lines (position from 0, line), as the organisers read it; examples: up to five.

    queries (q): the rows asked for; known (c): ids that may be matched, or none to leave that unasked. A wrong header is
    the only finding where there is one.
    """
    first = lines.where("position = 0").select("line")
    want = "\t".join(header)
    headers = first.select(F.when(~F.col("line").contains("\t") & F.col("line").contains(","), "comma_separated").when(F.array_join(F.transform(F.split(F.lower("line"), "\t"), lambda x: F.btrim(x)), "\t") != want, "header").alias("rule"), F.col("line").alias("example"))
    ok = headers.where("rule is null").limit(1).select(F.lit(1).alias("one"))
    body = lines.where("position > 0").withColumn("one", F.lit(1)).join(ok, "one", "left_semi")
    split = body.select("line", F.split("line", "\t", 2).alias("f"))
    malformed = split.where("size(f) < 2 and trim(line) <> ''").select(F.lit("malformed").alias("rule"), F.col("line").alias("example"))
    rows = split.where("size(f) = 2").select(F.col("f")[0].alias("q"), F.col("f")[1].alias("rest"))
    listed = rows.select("q", F.when(F.btrim("rest") == "", F.array().cast("array<string>")).otherwise(F.split("rest", ",")).alias("ids"))
    each = listed.select("q", F.explode(F.array_distinct("ids")).alias("c"))
    rule = lambda name, bad, column: bad.select(F.lit(name).alias("rule"), F.col(column).alias("example"))
    found = [
        headers.where("rule is not null"), malformed,
        rule("duplicate_row", listed.groupBy("q").agg(F.count("*").alias("n")).where("n > 1"), "q"),
        rule("repeated_id", listed.where(F.size(F.array_distinct("ids")) < F.size("ids")), "q"),
        rule("self_match", each.where(F.col("c").startswith("S1-")).select("c").distinct(), "c"),
        rule("wrong_prefix", each.where(~F.col("c").rlike("^S[123]-")).select("c").distinct(), "c"),
        rule("missing_row", queries.join(ok.withColumn("x", F.lit(1)), F.lit(True), "left_semi").join(listed.select("q"), "q", "left_anti"), "q"),
        rule("extra_row", listed.select("q").distinct().join(queries, "q", "left_anti"), "q"),
    ]
    if known is not None:
        found.append(rule("unknown_id", each.where(F.col("c").rlike("^S[23]-")).select("c").distinct().join(known, "c", "left_anti"), "c"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    numbered = out.withColumn("r", F.row_number().over(Window.partitionBy("rule").orderBy("example")))
    return numbered.groupBy("rule").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("r") <= 5, F.col("example")))).alias("examples"))


def normalized_records(records: DataFrame, stops: DataFrame | None = None, written_out: bool = False) -> DataFrame:
    """Records (country, id, name, address) with their cleaned forms: tokens, core tokens, joined tokens, grams and keys.

    stops: (country, stop), stop words of a country; written_out: legal forms in full.
    """
    cleaned = records.withColumns({"name_clean": T.clean_text(F.col("name")), "addr_clean": T.clean_text(F.col("address"))})
    words = T.tokens(F.col("name_clean"))
    told = cleaned.withColumn("tokens", T.written_out(words) if written_out else words)
    if stops is None:
        told = told.withColumn("core_tokens", F.col("tokens"))
    else:
        kept = F.filter("tokens", lambda t: ~F.coalesce(F.array_contains("stop", t), F.lit(False)))
        told = told.join(stops, "country", "left").withColumn("core_tokens", F.when(F.size(kept) > 0, kept).otherwise(F.col("tokens"))).drop("stop")
    return told.withColumns({"joined": F.array_join("tokens", ""), "ngrams": T.char_ngrams(F.col("name_clean")), "numeric_keys": F.array_union(T.numeric_keys(F.col("address")), T.numeric_keys(F.col("name")))})


# The parts of a run's report that transfer to another country is judged by.
TRANSFER = ("macro_f05", "singleton_accuracy", "matched_f05")


def transfer_deltas(baseline: DataFrame, transfer: DataFrame, ablated: DataFrame) -> DataFrame:
    """(country, measure, transfer_minus_baseline, ablation_minus_transfer) of measures (country, measure, value).

    Null where a value is missing or not a number.
    """
    of = lambda rows, name: rows.select("country", "measure", F.nanvl(F.col("value"), F.lit(None).cast("double")).alias(name))
    all_of = of(baseline, "a").join(of(transfer, "b"), ["country", "measure"], "full_outer").join(of(ablated, "c"), ["country", "measure"], "full_outer")
    return all_of.select("country", "measure", (F.col("b") - F.col("a")).alias("transfer_minus_baseline"), (F.col("c") - F.col("b")).alias("ablation_minus_transfer"))


def provenance_violations(runs: DataFrame, same: list[str], differing: list[str]) -> DataFrame:
    """(rule, n) of runs (run, and digests): columns that must have one value in all runs, or another in each."""
    counts = runs.agg(F.count("*").alias("runs"), F.count_distinct("run").alias("names"), *[F.count_distinct(c).alias(c) for c in same + differing], *[F.count_if(F.col(c).isNull()).alias(f"{c}_null") for c in same + differing])
    rules = {"repeated_run": F.col("runs") - F.col("names")} | {f"{c} differs": F.greatest(F.col(c) - 1, F.lit(0)) for c in same} | {f"{c} is shared": F.col("runs") - F.col(f"{c}_null") - F.col(c) for c in differing} | {f"{c} is missing": F.col(f"{c}_null") for c in same + differing}
    told = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), v.cast("bigint").alias("n")) for k, v in rules.items()])).alias("x")
    return counts.select(told).select("x.*").where("n > 0")
