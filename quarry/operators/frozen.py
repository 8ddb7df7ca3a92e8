"""Retrieval in three stages for a batch of tasks: candidates of several sources, a reranker, packing to a budget; and a second pass where keywords' files are missed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.common import written
from quarry.operators.index import expand_keywords, extract_keywords, grep_files, grep_index, hit_candidates
from quarry.operators.retrieval import pack_budget

#: An embedder maps a text to its vector, a reranker a task's and a chunk's text to a score; any function of Columns will do.
Embedder = Callable[[Column], Column]
Reranker = Callable[[Column, Column], Column]
#: Tasks of a batch, at most: their vectors go to every task of Spark's.
MAX_TASKS = 10_000
#: Scores are compared to so many places.
PLACES = 9
#: Scores that a task computes at a time, about.
SCORES = 1 << 21


def word_overlap(task: Column, chunk: Column) -> Column:
    """A reranker without a model: the share of distinct lower-case words that two texts have in common."""
    a, b = (F.array_distinct(F.split(F.lower(x), "[^a-z]+")) for x in (task, chunk))
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def error_files(text: Column, limit: int = 5) -> Column:
    """Files that a text's traceback lines name, the first `limit` lines, each once."""
    lines = F.regexp_extract_all(text, F.lit('File\\s+"([^"]+)",\\s*line\\s+(\\d+)'), F.lit(1))
    return F.array_distinct(F.slice(lines, 1, limit))


def _units(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of `width` numbers and a norm above 0, divided by it, a column each; and where they stood. Sums run from the first number to the last."""
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False))
    v = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width).T
    size = np.zeros(v.shape[1])
    for x in v:
        size += x * x
    size = np.sqrt(size)
    return np.ascontiguousarray(v[:, size > 0] / np.maximum(size[size > 0], 1e-12)), at[size > 0]


def _nearest(batches: Iterator[pa.RecordBatch], tasks: list[tuple[pa.Array, np.ndarray]], top: int) -> Iterator[pa.RecordBatch]:
    """(query, chunk, score) of batches (chunk, v): of this task's chunks the `top` nearest to each of `tasks`, a pair of queries and their units for each width."""
    held, kind = {}, None
    for batch in batches:
        kind = batch.schema.field("chunk").type
        for g, (_, q) in enumerate(tasks):
            units, at = _units(batch.column("v"), len(q))
            step = max(1, SCORES // q.shape[1])
            for start in range(0, len(at), step):
                c, names = units[:, start:start + step], batch.column("chunk").take(pa.array(at[start:start + step]))
                s, part = np.zeros((q.shape[1], c.shape[1])), np.empty((q.shape[1], c.shape[1]))
                for x, y in zip(q, c):
                    s += np.multiply(x[:, None], y[None, :], out=part)
                s = np.floor(s * 10**PLACES + 0.5) / 10**PLACES
                for j, row in enumerate(s):
                    scores, chunks = held.get((g, j), (np.empty(0), []))
                    near = np.flatnonzero((row > 0) & (row >= (scores[-1] if len(scores) == top else 0)))
                    if len(near) > top:
                        near = near[row[near] >= np.partition(row[near], -top)[-top]]
                    if len(near):
                        scores, chunks = np.concatenate([scores, row[near]]), chunks + names.take(pa.array(near)).to_pylist()
                        order = sorted(range(len(chunks)), key=lambda i: (-scores[i], chunks[i]))[:top]
                        held[g, j] = scores[order], [chunks[i] for i in order]
    for (g, j), (scores, chunks) in held.items():
        yield pa.RecordBatch.from_arrays([tasks[g][0].take(pa.array([j] * len(chunks))), pa.array(chunks, kind), pa.array(scores)], ["query", "chunk", "score"])


def nearest_chunks(chunks: DataFrame, tasks: DataFrame, embed: Embedder, top: int = 200) -> DataFrame:
    """(query, chunk, place): each task's (query, text) `top` chunks (chunk, text) of largest cosine above 0, ties to the smaller chunk.

    The batch of tasks, MAX_TASKS at most, meets every chunk; of each part of the chunks no more than `top` rows a task go on.
    Vectors of other lengths than a task's are not near it.
    """
    n = tasks.count()
    if n > MAX_TASKS:
        raise ValueError(f"{n} tasks; a batch has {MAX_TASKS} at most")
    t = tasks.select("query", embed(F.col("text")).cast("array<double>").alias("v")).toArrow()
    queries, vectors = (pa.concat_arrays(t.column(c).chunks) if t.num_rows else pa.array([], t.schema.field(c).type) for c in ("query", "v"))
    groups = []
    for width in sorted(x for x in pc.unique(pc.list_value_length(vectors)).to_pylist() if x):
        units, at = _units(vectors, width)
        if len(at):
            groups.append((queries.take(pa.array(at)), units))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((tasks, "query"), (chunks, "chunk"))]
    v = chunks.where("chunk is not null").select("chunk", embed(F.col("text")).cast("array<double>").alias("v"))
    s = v.mapInArrow(lambda batches: _nearest(batches, groups, top), ", ".join(kinds) + ", score double")
    return s.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "chunk"))).where(F.col("place") <= top).select("query", "chunk", "place")


def candidates(chunks: DataFrame, tasks: DataFrame, keywords: DataFrame, hits: DataFrame, embed: Embedder, ppr: DataFrame | None = None, top: int = 200) -> DataFrame:
    """(query, chunk, source, place) of a batch of tasks: the nearest chunks, the keywords' (query, pos, keyword) files, files that errors name, and `ppr` (query, chunk, place).

    hits are the files of keywords (query, keyword, path, place).
    A chunk comes once, by its first source; place numbers a query's candidates in the order of
    sources and of places in them. An error's path meets chunks whose file has the same last part.
    """
    near = nearest_chunks(chunks, tasks, embed, top).select("query", "chunk", F.lit(0).alias("source"), F.struct(F.lit(0).alias("a"), F.col("place").alias("b")).alias("pos"))
    words = hit_candidates(chunks, keywords, hits).select("query", "chunk", F.lit(1).alias("source"), F.struct(F.col("pos.keyword").alias("a"), F.col("pos.place").alias("b")).alias("pos"))
    named = tasks.select("query", F.posexplode(error_files(F.col("text"))).alias("a", "named")).withColumn("base", F.substring_index("named", "/", -1))
    errors = named.join(chunks.withColumn("base", F.substring_index("path", "/", -1)).select("chunk", "base"), "base").select("query", "chunk", F.lit(2).alias("source"), F.struct("a", F.lit(0).alias("b")).alias("pos"))
    found = near.unionByName(words).unionByName(errors)
    if ppr is not None:
        found = found.unionByName(ppr.select("query", "chunk", F.lit(3).alias("source"), F.struct(F.lit(0).alias("a"), F.col("place").cast("int").alias("b")).alias("pos")))
    first = found.groupBy("query", "chunk").agg(F.min(F.struct("source", "pos")).alias("s"))
    return first.select("query", "chunk", "s.source", F.row_number().over(W.partitionBy("query").orderBy("s", "chunk")).alias("place"))


def rerank(found: DataFrame, chunks: DataFrame, tasks: DataFrame, reranker: Reranker, top: int = 30) -> DataFrame:
    """(query, rank, chunk, path, text) of candidates (query, chunk, place): the `top` of largest score, ties to the earlier place."""
    x = found.join(chunks.select("chunk", "path", "text"), "chunk").join(tasks.select("query", F.col("text").alias("task")), "query")
    x = x.withColumn("score", F.round(reranker(F.col("task"), F.col("text")), PLACES))
    return x.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "place", "chunk"))).where(F.col("rank") <= top).select("query", "rank", "chunk", "path", "text")


def frozen_retrieval(index: DataFrame | None, chunks: DataFrame, tasks: DataFrame, files: DataFrame, embed: Embedder, reranker: Reranker = word_overlap, ppr: DataFrame | None = None, top_n: int = 200, top_k: int = 30, budget: int = 8192, coverage: float = 0.3) -> DataFrame:
    """(query, rank, chunk, path, tokens, second): the packed context of every task (query, text).

    Candidates are reranked, the best top_k packed to a budget of tokens. Where the files packed
    hold less than `coverage` of the files that the task's plain keywords find (five each), the chunks of
    those missed are added to the candidates, all are reranked and packed again, and `second` is true. A chunk that is
    added and was a candidate counts twice in that ranking; packing takes it once. chunks have (chunk, path, text), index is
    `build_index` of files (path, text), or None for a batch asked once: the texts are then read for its keywords. Tasks without a candidate have no rows.
    """
    plain = written(extract_keywords(tasks), "plain-keywords")
    keywords = written(expand_keywords(plain), "keywords")
    asked = keywords.select("query", "keyword").union(plain.select("query", "keyword"))
    hits = written(grep_files(files, asked) if index is None else grep_index(index, asked, files=files), "hits")
    found = written(candidates(chunks, tasks, keywords, hits, embed, ppr, top_n), "candidates")

    def packed(rows: DataFrame) -> DataFrame:
        ranked = rerank(rows, chunks, tasks, reranker, top_k).withColumn("header", F.concat(F.lit("# "), "path"))
        return pack_budget(ranked, budget).select("query", "rank", "chunk", "path", F.col("tokens").cast("long").alias("tokens"))

    one = written(packed(found), "packed")
    words = hits.join(plain.select("query", "keyword").distinct(), ["query", "keyword"]).select("query", "path").distinct()
    held = words.join(one.select("query", "path").distinct().withColumn("held", F.lit(True)), ["query", "path"], "left")
    held = written(held, "keyword-files")
    thin = held.groupBy("query").agg((F.count("held") / F.count("*")).alias("share")).where(F.col("share") < coverage).select("query")
    thin = written(thin.join(found.select("query").distinct(), "query"), "thin")
    # What meets the chunks is written first: as a table of known size it is sent to them, not they to it.
    missed = written(held.where("held is null").join(thin, "query").select("query", "path"), "missed").join(chunks.select("chunk", "path"), "path")
    after = found.groupBy("query").agg(F.max("place").alias("last"))
    missed = missed.join(after, "query").select("query", "chunk", (F.col("last") + F.row_number().over(W.partitionBy("query").orderBy("chunk"))).alias("place"))
    two = packed(written(found.select("query", "chunk", "place").join(thin, "query").unionByName(missed), "again"))
    return one.join(thin, "query", "left_anti").withColumn("second", F.lit(False)).unionByName(two.withColumn("second", F.lit(True)))
