"""Hybrid retrieval: ordered unions of candidates, coverage fallback and packing to a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUDGET = 8192


def union_first(sources: list[DataFrame], key: str = "chunk") -> DataFrame:
    """Rows (key, pos) of several sources in order; of equal keys the first source and position stay: (key, source_rank, pos)."""
    found = None
    for i, s in enumerate(sources):
        s = s.select(key, F.lit(i).alias("source_rank"), "pos")
        found = s if found is None else found.unionByName(s)
    return found.groupBy(key).agg(F.min(F.struct("source_rank", "pos")).alias("s")).select(key, "s.source_rank", "s.pos")


def pack_budget(ranked: DataFrame, budget: Column | int = BUDGET, group: str = "query") -> DataFrame:
    """Chunks (group, rank, text, header) in rank order while their tokens fit: exact repeats are skipped, the first overflow ends the pack."""
    cost = F.floor(F.length("header") / 4) + 1 + F.floor(F.length("text") / 4) + 1
    first = ranked.withColumn("_n", F.row_number().over(W.partitionBy(group, "header", F.md5("text")).orderBy("rank"))).where("_n = 1")
    run = F.sum(cost).over(W.partitionBy(group).orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    return first.withColumn("tokens", run).where(F.col("tokens") <= budget).drop("_n")
