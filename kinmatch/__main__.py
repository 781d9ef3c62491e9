"""python -m kinmatch COMMAND ...: verify, prep, baseline, block, audit, drift, inspect, expand, query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kinmatch.operators import decisions, metrics, similarity, statistics
from kinmatch.session import ship
from kinmatch.sources import tables


def main() -> None:
    parser = argparse.ArgumentParser(prog="kinmatch", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    for name, args in {
        "verify": ["source", "prefix"], "prep": ["source", "store", "split", "name"], "baseline": ["source", "out"], "block": ["store", "split", "out"],
        "audit": ["candidates", "matches"], "drift": ["candidates", "matches"], "inspect": ["candidates"], "expand": ["candidates", "out"], "query": ["name", "tables"],
    }.items():
        own = sub.add_parser(name)
        for arg in args:
            own.add_argument(arg)
        if name == "block":
            own.add_argument("--depth", type=int, default=50)
    a = parser.parse_args()
    spark = ship(SparkSession.builder.appName(f"kinmatch {a.command}").getOrCreate())
    as_records = lambda df: df.select(F.col("entity_id").alias("id"), F.col("business_name").alias("name"), F.col("business_address").alias("address"), "country")
    if a.command == "verify":
        statistics.table_report(as_records(tables.read_source(spark, a.source)), a.prefix).show(truncate=False)
    elif a.command == "prep":
        tables.write_store(tables.read_source(spark, a.source), a.store, a.split, a.name)
    elif a.command == "baseline":
        tables.write_id_lists(tables.read_source(spark, a.source).select("entity_id", F.array().cast("array<string>").alias("ids")), a.out, tables.CANDIDATES)
    elif a.command == "block":
        queries, corpus = as_records(tables.read_store(spark, a.store, a.split, "s1")), as_records(tables.read_store(spark, a.store, a.split).where("source <> 's1'"))
        fused = similarity.fuse_rrf(similarity.channel_hits(queries, corpus, list(similarity.CHANNELS.values())))
        best = similarity.top_per_query(fused, "rrf", a.depth).groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "c"))), lambda x: x["c"]).alias("ids"))
        tables.write_id_lists(queries.select(F.col("id").alias("q")).join(best, "q", "left").select("q", F.coalesce("ids", F.array().cast("array<string>")).alias("ids")), a.out, tables.CANDIDATES)
    elif a.command in ("audit", "drift"):
        candidates, matches = tables.read_candidates(spark, a.candidates), tables.read_truth(spark, a.matches).withColumnRenamed("matched", "ids")
        (decisions.audit(candidates.select("q"), candidates, matches) if a.command == "audit" else metrics.drift(candidates, matches)).show(truncate=False)
    elif a.command == "inspect":
        statistics.candidate_report(tables.read_candidates(spark, a.candidates)).show()
    elif a.command == "expand":
        statistics.expanded(tables.read_candidates(spark, a.candidates)).write.csv(a.out, sep="\t", quote="", header=True)
    else:
        from kinmatch.plans.catalog import QUERIES

        QUERIES[a.name](spark, a.tables).show(50, truncate=False)


if __name__ == "__main__":
    main()
