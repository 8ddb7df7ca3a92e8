"""Personalised PageRank over an edge table, and a code graph of Python sources."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.vectors import dot, l2_normalize
from quarry.operators.common import written


def personalized_pagerank(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, cut: int = 5) -> DataFrame:
    """(node, rank) after a fixed number of rounds; edges (source, target, weight, confidence), nodes and seeds (node).

    Moves are in proportion to weight * confidence. Seeds that are no nodes still divide the
    start. Rank of nodes without an edge returns to the seeds undamped; a node whose weights sum
    to 0 loses its rank. A round reads the ranks once: nodes without an edge send theirs to a
    sink, and the sink's sum goes on to the seeds in the same round. So the plan grows by one
    round at a time, the shuffle of the edges serves all rounds up to the next cut, and
    every `cut` rounds the ranks are written.
    """
    nodes = nodes.select("node").distinct()
    n_seeds = seeds.count()
    e = edges.withColumn("w", F.col("weight") * F.col("confidence"))
    total = e.groupBy("source").agg(F.sum("w").alias("total"))
    e = e.join(nodes.select(F.col("node").alias("target")), "target", "left_semi")  # what moves to no node is lost
    moves = e.join(total, "source").where("total > 0").select("source", "target", (F.lit(damping) * F.col("w") / F.col("total")).alias("share"))
    ends = nodes.join(total, nodes["node"] == total["source"], "left_anti").select(F.col("node").alias("source"), F.lit(None).cast(nodes.schema["node"].dataType).alias("target"), F.lit(1.0).alias("share"))
    moves = written(moves.unionByName(ends), "moves").repartition("source")
    start = written(nodes.join(seeds.withColumn("p", F.lit(1.0 / max(1, n_seeds))), "node").groupBy("node").agg(F.sum("p").alias("p")), "start")
    seeded = start.select(F.lit(-1).cast("long").alias("key"), F.col("node").alias("to"), "p")
    rank = start.select("node", F.col("p").alias("rank"))
    for i in range(rounds):
        sent = rank.join(moves, rank["node"] == moves["source"]).groupBy("target").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        key = F.when(F.col("target").isNull(), F.lit(-1).cast("long")).otherwise(F.xxhash64("target").bitwiseAND(F.lit((1 << 63) - 1)))
        got = sent.withColumn("key", key).join(seeded, "key", "left").select(F.coalesce("target", "to").alias("node"), (F.col("flow") * F.when(F.col("target").isNull(), F.coalesce("p", F.lit(0.0))).otherwise(1.0)).alias("flow")).where("node is not null")
        rank = got.unionByName(start.select("node", (F.lit(1 - damping) * F.col("p")).alias("flow"))).groupBy("node").agg(F.sum("flow").alias("rank"))
        if i % cut == cut - 1 and i + 1 < rounds:
            rank = written(rank, "rank")
    return rank.where("rank > 0").select("node", "rank")


def ppr_seeds(nodes: DataFrame, query: Column, top: int = 3) -> DataFrame:
    """(node, score) of the functions and classes among nodes (node, kind, embedding) nearest to a query vector.

    The score is the inner product with the normalised query; ties go to the smaller node. Nodes
    without an embedding, or with one of another length, are no seeds.
    """
    scored = nodes.where(F.col("kind").isin("function", "class")).select("node", dot(F.col("embedding"), l2_normalize(query)).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), "node").limit(top)


def candidates_ppr(rank: DataFrame, nodes: DataFrame, chunks: DataFrame, top: int = 100) -> DataFrame:
    """(chunk, pos) of the files of the `top` nodes by rank (node, rank), ties to the smaller node.

    Nodes have (node, file), chunks (chunk, path); pos, from 1, is that of a chunk's first node.
    The ranked nodes are `top` rows at most, so numbering them takes one small task.
    """
    best = rank.orderBy(F.desc("rank"), "node").limit(top)
    best = best.withColumn("pos", F.row_number().over(W.orderBy(F.desc("rank"), "node")))
    files = best.join(nodes, "node").groupBy("file").agg(F.min("pos").alias("pos"))
    return chunks.join(F.broadcast(files), chunks["path"] == files["file"]).select("chunk", "pos")


def python_graph(sources: DataFrame) -> DataFrame:
    """Classes, functions, imports and calls of Python sources (path, text): (path, kind, name, line). Text that is no Python gives nothing."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf.path, pdf.text):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for x in ast.walk(tree):
                    if isinstance(x, ast.ClassDef):
                        out.append((path, "class", x.name, x.lineno))
                    elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                        out.append((path, "function", x.name, x.lineno))
                    elif isinstance(x, ast.Import):
                        out += [(path, "imports", a.name, x.lineno) for a in x.names]
                    elif isinstance(x, ast.ImportFrom) and x.module:
                        out.append((path, "imports", x.module, x.lineno))
                    elif isinstance(x, ast.Call) and isinstance(x.func, ast.Name):
                        out.append((path, "calls", x.func.id, x.lineno))
            yield pd.DataFrame(out, columns=["path", "kind", "name", "line"])

    return sources.select("path", "text").mapInPandas(run, "path string, kind string, name string, line long")


def resolve_calls(found: DataFrame) -> DataFrame:
    """Calls with the definition that their name finds: functions before classes, the first by path and line."""
    d = found.where("kind in ('function', 'class')").groupBy("name").agg(F.min(F.struct(F.when(F.col("kind") == "function", 0).otherwise(1).alias("k"), "path", "line")).alias("d"))
    return found.where("kind = 'calls'").join(d, "name").select("path", "line", "name", F.col("d.path").alias("target_path"), F.col("d.line").alias("target_line"))
