"""How the driver's tables stand in for records, pairs, truths and labels; each view in Spark and, as text, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.session import table

CLEAN = r"trim(regexp_replace(regexp_replace(replace(strip_accents(lower({0})),'ß','ss'),'[\p{{P}}\p{{S}}\p{{C}}]+',' ','g'),'\s+',' ','g'))"
TOKENS = "list_filter(string_split({0},' '), lambda x: x<>'')"
KEYS = r"""list_distinct(flatten(list_transform(list_filter(regexp_extract_all({0},'[A-Za-z0-9]+(?:-[A-Za-z0-9]+)*'), lambda x: regexp_matches(x,'[0-9]')),
 lambda x: case when regexp_full_match(x,'[0-9]+(-[0-9]+)+') then list_transform(string_split(x,'-'), lambda p: regexp_replace(p,'^0+(.)','\1'))
 else [array_to_string(list_transform(string_split(lower(x),'-'), lambda p: case when regexp_full_match(p,'[0-9]+') then regexp_replace(p,'^0+(.)','\1') else p end),'')] end)))"""
NGRAMS = "case when length({0})=0 then [] when length({0})<3 then [{0}] else list_transform(range(1,length({0})-1), lambda i: substring({0},i,3)) end"


def clean_sql(x: str) -> str:
    return CLEAN.format(x)


def texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Passages as queries, documents as corpus; one country."""
    q, c = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    record = lambda df, key: df.select(F.lit("all").alias("country"), F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("name"), F.lit("").alias("address"))
    return record(q, "item_id"), record(c, "doc_id")


def parties(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as queries, customers as corpus; nations as countries."""
    s, c = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")

    def record(df: DataFrame, key: str, name: str, nation: str, zero: str) -> DataFrame:
        k = F.col(key)
        address = F.concat(F.lit("AF-" + zero), (k % 97).cast("string"), F.lit(" block "), (k % 13).cast("string"), F.lit(", zone "), (k % 5).cast("string"), F.lit(", area "), (k % 11).cast("string"))
        return df.select(F.col(nation).cast("string").alias("country"), k.alias("id"), F.col(name).alias("name"), F.when(k % 29 == 0, "").otherwise(address).alias("address"))

    return record(s, "s_suppkey", "s_name", "s_nationkey", ""), record(c, "c_custkey", "c_name", "c_nationkey", "0")


def _party_sql(df: str, key: str, name: str, nation: str, zero: str) -> str:
    return f"select cast({nation} as varchar) country, {key} id, {name} as name, case when {key}%29=0 then '' else concat('AF-{zero}',{key}%97,' block ',{key}%13,', zone ',{key}%5,', area ',{key}%11) end address from {df}"


PARTY_Q = _party_sql("supplier", "s_suppkey", "s_name", "s_nationkey", "")
PARTY_C = _party_sql("customer", "c_custkey", "c_name", "c_nationkey", "0")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, q, c, p) from orders."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_orderstatus").alias("country"), F.col("o_custkey").alias("q"), (F.col("o_orderkey") % 997).alias("c")).agg(F.least(F.lit(1.0), F.max("o_totalprice") / 600000).alias("p"))


SCORED = "select o_orderstatus country, o_custkey q, o_orderkey%997 c, least(1.0::double, max(o_totalprice)/600000) p from orders group by all"


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(country, q, matched): urgent orders of each customer; customers without any are singletons."""
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("q")).agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 997)).alias("matched"))
    all_q = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("country"), F.col("c_custkey").alias("q"))
    return all_q.join(urgent, "q", "left").select("country", "q", F.coalesce("matched", F.array().cast("array<bigint>")).alias("matched"))


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(q, ids): candidate lists, customers' orders not of low priority."""
    return table(spark, sf_dir, "orders").where("o_orderpriority <> '5-LOW'").groupBy(F.col("o_custkey").alias("q")).agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 997)).alias("ids"))


TRUTH = "select cast(c_nationkey as varchar) country, c_custkey q, coalesce(m,[]) matched from customer left join (select o_custkey, list_sort(list(distinct o_orderkey%997)) m from orders where o_orderpriority='1-URGENT' group by 1) on o_custkey=c_custkey"
LISTED = "select o_custkey q, list_sort(list(distinct o_orderkey%997)) ids from orders where o_orderpriority<>'5-LOW' group by 1"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a label and a few numbers."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", F.length(F.regexp_replace("text", "[^|#*$%!&]", "")).alias("n_marks"), F.length(F.regexp_replace("text", "[^\\n]", "")).alias("n_lines"))
    return d.join(table(spark, sf_dir, "labels"), "doc_id").withColumns({"mark_share": F.col("n_marks") / F.col("n_chars"), "label": F.col("quality").cast("bigint")})


LABELLED = "select doc_id, lang, n_chars, length(regexp_replace(text,'[^|#*$%!&]','','g'))/n_chars mark_share, cast(quality as bigint) as label from documents join labels using(doc_id)"
