"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Nodes are joined by their number XOR this: the exchanges then stand right below the join, where Spark can split a hot node's rows.
_APART = 0x5851F42D4C957F2D


#: Links (32 bytes each) up to which a round takes as many tasks as they fill, rather than the session's number; and those of one.
SMALL_LINKS = 1 << 21
TASK_LINKS = 1 << 18


def _dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return df.repartition(n, *keys) if n else df


def _neighbour_min(pairs: DataFrame, n: int | None) -> DataFrame:
    """pairs (u, v) with the least of u and its v as m.

    The other side has one row per u. If the join could use the aggregate's own exchange,
    all links of a hot u would stay in one task; with a key of its own, adaptive execution splits them.
    """
    least = _dealt(pairs, n, "u").groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(_APART)).alias("k"), "m")
    apart = pairs.withColumn("k", F.col("u").bitwiseXOR(F.lit(_APART)))
    return _dealt(apart, n, "k").join(_dealt(least, n, "k"), "k").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Each linked node with the smallest node that it reaches: links (a, b) long -> (node, component).

    Alternating large-star and small-star rounds: every round hangs a node's larger
    neighbours, then its smaller ones, on the smallest node near it, so the number of
    links never grows and depth shrinks by a factor each time. Each round is written
    to the shared folder; nothing is gathered on the driver but a count and a checksum.
    Null ends and links of a node to itself are ignored; an empty table gives an empty one.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialize(edges, "links")

    def sign(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = sign(edges)
    for _ in range(max_rounds):
        if not before[0]:
            break
        n = max(1, -(-before[0] // TASK_LINKS)) if before[0] <= SMALL_LINKS else None
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _dealt(_neighbour_min(both, n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), n, "u", "v").distinct()
        near = _neighbour_min(large, n)
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(near.select("u", F.col("m").alias("v")))
        edges = materialize(_dealt(small.select("u", "v"), n, "u", "v").distinct(), "links")
        after = sign(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots.select("node", F.col("node").alias("component")))
