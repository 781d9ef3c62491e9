"""Features of pairs: sets, strings, ranks and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinmatch.functions import text as T
from kinmatch.operators.compare import Dealt

BASE = ["name_trigram_jaccard", "name_token_jaccard", "name_token_containment", "name_jaro_winkler", "name_token_set_ratio", "name_len_ratio", "addr_trigram_jaccard", "addr_token_jaccard", "addr_jaro_winkler", "digit_jaccard", "digit_shared_count", "addr_missing", "rrf_score", "n_channels_hit", "best_channel_rank", "is_source3"]
CONTEXT = ["candidate_rank", "score_margin_to_best", "score_ratio_to_best", "candidate_count", "reverse_rank", "shared_rare_address_tokens", "city_region_agreement"]

# Weights of the lexical surrogate score.
LEXICAL_WEIGHTS = {"name_trigram_jaccard": 0.14, "name_token_jaccard": 0.10, "name_jaro_winkler": 0.10, "addr_trigram_jaccard": 0.20, "addr_token_jaccard": 0.20, "addr_jaro_winkler": 0.16, "digit_jaccard": 0.10}


def forms(records: DataFrame) -> DataFrame:
    """Cleaned strings and distinct grams, tokens and digit keys of (country, id, name, address), worked out once a record."""
    cleaned = records.select("country", "id", "address", T.clean_text(F.col("name")).alias("name_clean"), T.clean_text(F.col("address")).alias("addr_clean"))
    return cleaned.select(
        "country", "id", "address", "name_clean", "addr_clean",
        F.array_distinct(T.char_ngrams(F.col("name_clean"))).alias("name_tri"), F.array_distinct(T.tokens(F.col("name_clean"))).alias("name_tok"),
        F.array_distinct(T.char_ngrams(F.col("addr_clean"))).alias("addr_tri"), F.array_distinct(T.tokens(F.col("addr_clean"))).alias("addr_tok"), T.numeric_keys(F.col("address")).alias("digits"),
    )


def with_forms(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """pairs (country, q, c, ...) with structs fq and fc of both records' forms.

    Forms are many times larger than the files that Spark estimates them by. They are hashed in shuffled parts, never
    sent to all tasks, and pairs that have forms already are not sorted.
    """
    q = queries.select("country", F.col("id").alias("q"), F.struct(*[c for c in queries.columns if c not in ("country", "id")]).alias("fq"))
    c = corpus.select("country", F.col("id").alias("c"), F.struct(*[c for c in corpus.columns if c not in ("country", "id")]).alias("fc"))
    return pairs.join(q.hint("shuffle_hash"), ["country", "q"]).join(c.hint("shuffle_hash"), ["country", "c"])


def set_features() -> dict[str, Column]:
    q, c = (lambda x: F.col(f"fq.{x}")), (lambda x: F.col(f"fc.{x}"))
    both = F.size(F.array_intersect(q("digits"), c("digits")))
    long = F.greatest(F.length(q("name_clean")), F.length(c("name_clean")))
    short = F.least(F.length(q("name_clean")), F.length(c("name_clean")))
    return {
        "name_trigram_jaccard": T.jaccard(q("name_tri"), c("name_tri")), "name_token_jaccard": T.jaccard(q("name_tok"), c("name_tok")), "name_token_containment": T.containment(q("name_tok"), c("name_tok")),
        "name_len_ratio": F.when(short > 0, short / long).otherwise(0.0), "addr_trigram_jaccard": T.jaccard(q("addr_tri"), c("addr_tri")), "addr_token_jaccard": T.jaccard(q("addr_tok"), c("addr_tok")),
        "digit_jaccard": T.jaccard(q("digits"), c("digits")), "digit_shared_count": both.cast("double"), "addr_missing": F.when((q("addr_clean") == "") | (c("addr_clean") == ""), 1.0).otherwise(0.0),
    }


def string_features() -> dict[str, Column]:
    q, c = (lambda x: F.col(f"fq.{x}")), (lambda x: F.col(f"fc.{x}"))
    return {
        "name_jaro_winkler": T.jaro_winkler(q("name_clean"), c("name_clean")), "name_token_set_ratio": T.token_set_ratio(q("name_clean"), c("name_clean")),
        "addr_jaro_winkler": F.when((q("addr_clean") != "") & (c("addr_clean") != ""), T.jaro_winkler(q("addr_clean"), c("addr_clean"))).otherwise(0.0),
    }


def base_features(pairs: DataFrame) -> DataFrame:
    """The 16 base features of pairs that have fq, fc, rrf, n_hit, best_rank and is_s3."""
    made = set_features() | string_features() | {"rrf_score": F.col("rrf"), "n_channels_hit": F.col("n_hit").cast("double"), "best_channel_rank": F.col("best_rank").cast("double"), "is_source3": F.col("is_s3").cast("double")}
    return pairs.select("country", "q", "c", *[made[x].alias(x) for x in BASE])


#: The values of dealt pairs that are features.
VALUES = {"rrf_score": "rrf", "n_channels_hit": "n_hit", "best_channel_rank": "best_rank", "is_source3": "is_s3"}


def dealt_features(dealt: Dealt, features: list[str]) -> DataFrame:
    """Base features of all pairs of dealt lists (compare.py), equal to those of base_features()."""
    return dealt.compared([x for x in features if x not in VALUES], {x: VALUES[x] for x in features if x in VALUES}).select("country", "q", "c", *features)


def lexical_score() -> Column:
    total = sum((F.lit(w) * F.col(x) for x, w in LEXICAL_WEIGHTS.items()), F.lit(0.0))
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def linear_score(mean: dict[str, float], scale: dict[str, float], coefficient: dict[str, float], intercept: float) -> Column:
    """((x - mean) / scale) . coefficient + intercept, with the constants folded into one weight a feature."""
    shift = intercept - sum(mean[x] / scale[x] * coefficient[x] for x in coefficient)
    return sum((F.lit(coefficient[x] / scale[x]) * F.col(x) for x in coefficient), F.lit(shift))


def forward_ranks(pairs: DataFrame, score: str = "score") -> DataFrame:
    order = Window.partitionBy("country", "q").orderBy(F.desc(score), "c")
    whole = Window.partitionBy("country", "q")
    best = F.max(score).over(whole)
    return pairs.withColumns({"candidate_rank": F.row_number().over(order), "score_margin_to_best": best - F.col(score), "score_ratio_to_best": F.when(F.abs(best) > 1e-12, F.col(score) / best).otherwise(0.0), "candidate_count": F.count("*").over(whole)})


def reverse_ranks(pairs: DataFrame, score: str = "score") -> DataFrame:
    return pairs.withColumn("reverse_rank", F.row_number().over(Window.partitionBy("country", "c").orderBy(F.desc(score), "q")))


def address_df(corpus_forms: DataFrame) -> DataFrame:
    """(country, token, df, n) over the corpus side only."""
    n = corpus_forms.groupBy("country").agg(F.count("*").alias("n"))
    return corpus_forms.select("country", F.explode("addr_tok").alias("token")).groupBy("country", "token").agg(F.count("*").alias("df")).join(F.broadcast(n), "country")


def rare_tokens(record_forms: DataFrame, df: DataFrame, fraction: float = 0.01) -> DataFrame:
    """(country, id, rare): address tokens in at least one and at most max(1, fraction) of the corpus."""
    rare = df.where(F.col("df") <= F.greatest(F.lit(1), F.floor(fraction * F.col("n")))).select("country", "token")
    kept = record_forms.select("country", "id", F.explode("addr_tok").alias("token")).join(rare.hint("shuffle_hash"), ["country", "token"])
    return kept.groupBy("country", "id").agg(F.collect_set("token").alias("rare"))


def location_weights(records: DataFrame, df: DataFrame, corpus: DataFrame) -> DataFrame:
    """(country, id, places): location tokens with ln(1 + N / (1 + df)); an unseen token counts as in every record."""
    n = corpus.groupBy("country").agg(F.count("*").alias("n"))
    at = records.select("country", "id", F.explode(T.location_tokens(F.col("address"))).alias("token"))
    weighed = at.join(df.select("country", "token", "df").hint("shuffle_hash"), ["country", "token"], "left").join(F.broadcast(n), "country").withColumn("w", F.log1p(F.col("n") / (1 + F.coalesce("df", "n"))))
    return weighed.groupBy("country", "id").agg(F.map_from_entries(F.collect_list(F.struct("token", "w"))).alias("places"))


def location_agreement(a: Column, b: Column) -> Column:
    """Weight of the shared location tokens over that of all; a and b map tokens to weights."""
    keys_a, keys_b = F.map_keys(a), F.map_keys(b)
    all_of = F.map_concat(a, F.map_filter(b, lambda k, v: ~F.array_contains(keys_a, k)))
    total = F.aggregate(F.map_values(all_of), F.lit(0.0), lambda acc, x: acc + x)
    shared = F.aggregate(F.array_intersect(keys_a, keys_b), F.lit(0.0), lambda acc, k: acc + F.element_at(a, k))
    return F.coalesce(F.when(total > 0, shared / total), F.lit(0.0))


def agreeing_pairs(queries: DataFrame, corpus: DataFrame, df: DataFrame, digits: int = 6) -> DataFrame:
    """(country, q, c, agreement), rounded to digits, of all pairs that share a location token.

    Records of a country with the same location tokens are one class. Classes meet and agree; pairs of records are made
    last, from the classes' members, and are not shuffled. The number of parts is told, as pairs are many times more than
    the rows that Spark would estimate them by.
    """
    parts = int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def classes(records: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        own = records.select("country", "id", "address", F.array_join(F.array_sort(F.array_distinct(T.location_tokens(F.col("address")))), " ").alias("places")).where("places <> ''")
        each = own.groupBy("country", F.col("places").alias("id")).agg(F.min("address").alias("address"))
        weighed = location_weights(each, df, corpus).select("country", F.col("id").alias(f"class_{side}"), F.col("places").alias(f"p{side}"))
        return weighed, own.select("country", F.col("places").alias(f"class_{side}"), F.col("id").alias(side))

    (a, of_q), (b, of_c) = classes(queries, "q"), classes(corpus, "c")
    meet = a.select("country", "class_q", F.explode(F.map_keys("pq")).alias("t")).join(b.select("country", "class_c", F.explode(F.map_keys("pc")).alias("t")), ["country", "t"]).select("country", "class_q", "class_c").distinct()
    agree = meet.join(a, ["country", "class_q"]).join(b, ["country", "class_c"]).select("country", "class_q", "class_c", F.round(location_agreement(F.col("pq"), F.col("pc")), digits).alias("agreement"))
    asking = agree.join(of_q.hint("merge"), ["country", "class_q"]).select("country", "class_c", "q", "agreement")
    met = asking.repartition(parts, "country", "class_c").join(of_c.repartition(parts, "country", "class_c").hint("merge"), ["country", "class_c"])
    return met.select("country", "q", "c", "agreement")
