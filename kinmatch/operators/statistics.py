"""Document frequencies, stop lists, profiles and checks of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def token_frequencies(records: DataFrame, tokens: Column) -> DataFrame:
    """(country, token, cnt, frac): records with the token, of those of the country with any token."""
    own = records.select("country", "id", F.array_distinct(tokens).alias("t")).where("size(t) > 0")
    n = own.groupBy("country").agg(F.count("*").alias("n"))
    return own.select("country", F.explode("t").alias("token")).groupBy("country", "token").agg(F.count("*").alias("cnt")).join(n, "country").select("country", "token", "cnt", (F.col("cnt") / F.col("n")).alias("frac"))


def stop_lists(frequencies: DataFrame, share: float = 0.05) -> DataFrame:
    """(country, stop): at most 1 / share of a record's average length in tokens for each country."""
    return frequencies.where(F.col("frac") >= share).groupBy("country").agg(F.array_sort(F.collect_list("token")).alias("stop"))


def without_stop_tokens(tokens: Column, stop: Column) -> Column:
    """What is not in the stop list, or everything if nothing else is left."""
    kept = F.array_except(tokens, stop)
    rest = F.filter(tokens, lambda t: ~F.array_contains(stop, t))
    return F.when(stop.isNull() | (F.size(kept) == 0), tokens).otherwise(rest)


def core_counts(records: DataFrame, tokens: Column, frequencies: DataFrame, share: float = 0.05) -> DataFrame:
    """(country, id, n_core) of each record (country, id): tokens that are not stop words of the country, or all if no others are left.

    Tokens meet the stop words in a join, which is hashed where they are few by measured size.
    """
    stops = frequencies.where(F.col("frac") >= share).select("country", "token", F.lit(1).alias("stop"))
    own = records.withColumn("row", F.monotonically_increasing_id()).select("country", "id", "row", F.explode_outer(tokens).alias("token"))
    counted = own.join(stops, ["country", "token"], "left").groupBy("row").agg(F.first("country").alias("country"), F.first("id").alias("id"), F.count("token").alias("n"), F.count("stop").alias("k"))
    return counted.select("country", "id", F.when(F.col("k") == F.col("n"), F.col("n")).otherwise(F.col("n") - F.col("k")).alias("n_core"))


def top_tokens(frequencies: DataFrame, k: int = 18) -> DataFrame:
    w = Window.partitionBy("country").orderBy(F.desc("cnt"), "token")
    return frequencies.withColumn("rank", F.row_number().over(w)).where(f"rank <= {k}")


def script_census(records: DataFrame, script: Column, k: int = 5) -> DataFrame:
    n = records.select("country", script.alias("script")).groupBy("country", "script").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("country"))
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("n"), "script"))
    return n.withColumns({"share": F.col("n") / whole, "rank": rank}).where(f"rank <= {k}")


def table_report(records: DataFrame, id_prefix: str) -> DataFrame:
    """One row: rows, ids that lack the prefix, repeated ids, countries, blank names and addresses."""
    ids = records.groupBy("id").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("duplicate_ids"))
    rest = records.agg(F.count("*").alias("n_rows"), F.count_if(~F.col("id").startswith(id_prefix)).alias("bad_prefix"), F.count_distinct("country").alias("countries"), F.count_if(F.btrim("name") == "").alias("blank_names"), F.count_if(F.btrim("address") == "").alias("blank_addresses"))
    return rest.withColumn("one", F.lit(1)).join(ids.withColumn("one", F.lit(1)), "one").drop("one")


def claimed_often(truth: DataFrame) -> DataFrame:
    """(c, k): records that more than one query claims. truth (q, matched)."""
    return truth.select("q", F.explode("matched").alias("c")).groupBy("c").agg(F.count_distinct("q").alias("k")).where("k > 1")


def truth_shape(truth: DataFrame) -> DataFrame:
    return truth.groupBy(F.size("matched").alias("matches")).agg(F.count("*").alias("n"))


def distractors(corpus: DataFrame, truth: DataFrame) -> DataFrame:
    """Records of the corpus (c) that no query claims."""
    return corpus.join(truth.select(F.explode("matched").alias("c")).distinct(), "c", "left_anti")


def reachability(pairs: DataFrame) -> DataFrame:
    """Of pairs (country, name_j, addr_j, shared_digits): how many a name, an address or a number can find, by country and in all."""
    name, addr = F.col("name_j") >= 0.15, (F.col("addr_j") >= 0.20) | F.col("shared_digits")
    flagged = pairs.select("country", name.cast("int").alias("a"), addr.cast("int").alias("b"), (name | addr).cast("int").alias("e"), (addr & ~name).cast("int").alias("ra"), (name & ~addr).cast("int").alias("rn"))
    return flagged.rollup("country").agg(F.count("*").alias("n_pairs"), F.sum("a").alias("by_name"), F.sum("b").alias("by_address"), F.sum("e").alias("by_either"), F.sum("ra").alias("only_address"), F.sum("rn").alias("only_name")).withColumn("country", F.coalesce("country", F.lit("ALL")))


def candidate_report(lists: DataFrame) -> DataFrame:
    n = F.size("ids")
    return lists.agg(F.count("*").alias("n_rows"), F.sum(n).alias("n_pairs"), F.min(n).alias("least"), F.max(n).alias("most"), F.count_if(n == 0).alias("n_empty"))


def expanded(lists: DataFrame) -> DataFrame:
    """(q, c, position): one row a listed pair, positions from 1."""
    return lists.select("q", F.posexplode("ids").alias("p", "c")).select("q", "c", (F.col("p") + 1).alias("position"))
