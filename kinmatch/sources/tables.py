"""Tab-separated sources and sinks without quoting, and the country-partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE = ("entity_id", "business_name", "business_address", "country")
TRUTH = ("source1_entity_id", "matched_entity_ids")
CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
PAIRS = ("source1_entity_id", "candidate_entity_id", "rrf_score", "n_channels_hit", "best_channel_rank", "reranker_score")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as strings, empty fields as empty strings. Another header, or a row of another width, is an error."""
    head = spark.read.text(path).limit(1).collect()
    if not head or tuple(head[0][0].rstrip("\r").split("\t")) != tuple(columns):
        raise ValueError(f"{path}: the header is not {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.read.schema(schema).csv(path, sep="\t", quote="", escape="", header=True, enforceSchema=False, mode="FAILFAST", nullValue="\0", emptyValue="")
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def id_list(column: str):
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, ","))


def read_source(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, SOURCE)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, TRUTH)
    return rows.select(F.col(TRUTH[0]).alias("q"), F.array_distinct(id_list(TRUTH[1])).alias("matched"))


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, CANDIDATES)
    return rows.select(F.col(CANDIDATES[0]).alias("q"), id_list(CANDIDATES[1]).alias("ids"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = read_tsv(spark, path, PAIRS)
    return rows.select(*PAIRS[:2], *[F.col(c).cast("double").alias(c) for c in PAIRS[2:]])


def write_store(rows: DataFrame, path: str, split: str, source: str) -> None:
    """Adds a source to the store, a folder for each split, source and country."""
    rows.withColumns({"split": F.lit(split), "source": F.lit(source)}).write.mode("append").partitionBy("split", "source", "country").option("compression", "zstd").parquet(path)


def read_store(spark: SparkSession, path: str, split: str, source: str | None = None, country: str | None = None) -> DataFrame:
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).where(F.col("split") == split)
    for name, value in (("source", source), ("country", country)):
        rows = rows.where(F.col(name) == value) if value is not None else rows
    return rows


def read_ids(spark: SparkSession, path: str, prefix: str = "", unique: bool = True) -> DataFrame:
    """(id): the first field of every line but the header; blank lines do not count. Other prefixes and repeats are errors."""
    lines = spark.read.text(path).select(F.split("value", "\t")[0].alias("id"))
    head = lines.limit(1).collect()
    rows = lines.where(F.btrim("id") != "").where(F.col("id") != head[0][0]) if head else lines
    _refuse(rows.where(~F.col("id").startswith(prefix)), f"{path}: an id without the prefix {prefix}")
    if unique:
        _refuse(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1"), f"{path}: an id that repeats")
    return rows


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """(q, ids) of a file of matches; a query or an id of a list that repeats is an error."""
    rows = read_tsv(spark, path, TRUTH).select(F.col(TRUTH[0]).alias("q"), id_list(TRUTH[1]).alias("ids"))
    _refuse(rows.groupBy("q").agg(F.count("*").alias("n")).where("n > 1"), f"{path}: a query that repeats")
    _refuse(rows.where(F.size(F.array_distinct("ids")) < F.size("ids")).select("q"), f"{path}: a list with an id that repeats")
    return rows


def read_test_ids(spark: SparkSession, store: str, prefix: str = "S1-") -> DataFrame:
    """(id) of the queries of the store's test split."""
    rows = read_store(spark, store, "test", "s1").select(F.col("entity_id").alias("id"))
    _refuse(rows.where(~F.col("id").startswith(prefix)), f"{store}: an id without the prefix {prefix}")
    return rows


def read_features(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The columns asked for of a folder of features; one that is not there is an error."""
    rows = spark.read.parquet(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no columns {missing}")
    return rows.select(*columns)


def write_areas(rows: DataFrame, path: str) -> None:
    """(feature, auc, neutral) with six decimals."""
    rows.select("feature", *[F.format_string("%.6f", c).alias(c) for c in ("auc", "neutral")]).coalesce(1).write.mode("errorifexists").csv(path, sep="\t", header=True)


def _refuse(bad: DataFrame, what: str) -> None:
    found = bad.limit(1).collect()
    if found:
        raise ValueError(f"{what}: {found[0][0]}")


def countries(spark: SparkSession, path: str, split: str, source: str = "s1") -> list[str]:
    return sorted(r[0] for r in read_store(spark, path, split, source).select("country").distinct().collect())


def write_id_lists(rows: DataFrame, path: str, header: tuple[str, str]) -> None:
    """Folder of text files `id<TAB>a,b,c`, each with the header; refuses to overwrite."""
    lines = rows.select(F.concat_ws("\t", rows.columns[0], F.array_join(rows.columns[1], ",")).alias(header[0] + "\t" + header[1]))
    lines.write.mode("errorifexists").csv(path, sep="\x01", quote="", escape="", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_pairs(rows: DataFrame, path: str) -> None:
    rows.select(*PAIRS).write.mode("errorifexists").csv(path, sep="\t", quote="", escape="", header=True)


def write_features(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").partitionBy("country").option("compression", "zstd").parquet(path)


def write_report(row: DataFrame, path: str) -> None:
    row.write.mode("errorifexists").json(path)
