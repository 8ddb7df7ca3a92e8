"""Approximate nearest neighbours with learned partitions.

On a bounded sample, a graph of nearest neighbours is cut into balanced parts, and a small
classifier learns which part a vector belongs to. All rows are indexed by their likeliest
part; a query goes to several likeliest parts and every vector there is scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import materialize

#: Rows that the graph and the classifier are fitted on, at most.
SAMPLE = 8_192
#: Vectors that a part of the sample has, and parts, at most; a sample below two such parts is cut into parts of SMALL_PART.
PART_ROWS = 512
SMALL_PART = 100
MAX_PARTS = 64
NEIGHBOURS = 20
#: Queries are routed to as many parts as find this share of the sample's own neighbours.
TARGET_RECALL = 0.96
#: Vectors of a block: a part is dealt into blocks of about this many, scored one by one.
BLOCK_ROWS = 4_096
QUERY_ROWS = 1_024


def top_inner(q: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k largest inner products with x (float64 rows)."""
    s = q @ x.T
    k = min(k, x.shape[0])
    return np.argpartition(-s, k - 1, axis=1)[:, :k]


def balanced_parts(graph: np.ndarray, n_parts: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Labels of a balanced partition of a neighbour graph (row i has i's neighbours): few edges between parts.

    Halves are cut recursively. Each half starts from the second eigenvector of the graph's
    random walk (power iteration), split at its quantile, and is refined by swapping the pairs
    of nodes that gain the most edges within halves; sizes differ by one at most.
    """
    rng = np.random.default_rng(seed)
    n = len(graph)
    label = np.zeros(n, np.int64)

    def split(nodes: np.ndarray, parts: int, first: int) -> None:
        if parts == 1 or len(nodes) < 2:
            label[nodes] = first
            return
        left = parts // 2
        where = np.full(n, -1)
        where[nodes] = np.arange(len(nodes))
        local = where[graph[nodes]]
        src, dst = np.nonzero(local >= 0)[0], local[local >= 0]
        degree = np.bincount(src, minlength=len(nodes)) + np.bincount(dst, minlength=len(nodes)) + 1e-9

        def spread(v: np.ndarray) -> np.ndarray:
            return np.bincount(src, v[dst], len(nodes)) + np.bincount(dst, v[src], len(nodes))

        v = rng.standard_normal(len(nodes))
        for _ in range(60):
            v -= (v * degree).sum() / degree.sum()
            v = (v + spread(v) / degree) / 2
            v /= np.linalg.norm(v) + 1e-30
        size = len(nodes) * left // parts
        side = np.zeros(len(nodes), bool)
        side[np.argsort(v, kind="stable")[:size]] = True
        for _ in range(rounds):
            pull = spread(np.where(side, 1.0, -1.0)) * np.where(side, -1.0, 1.0)  # edges gained by changing sides
            a, b = np.flatnonzero(side), np.flatnonzero(~side)
            a, b = a[np.argsort(-pull[a], kind="stable")], b[np.argsort(-pull[b], kind="stable")]
            m = min(len(a), len(b), max(1, len(nodes) // 20))
            gain = pull[a[:m]] + pull[b[:m]] > 2
            if not gain.any():
                break
            cut_before = (side[src] != side[dst]).sum()
            side[a[:m][gain]], side[b[:m][gain]] = False, True
            if (side[src] != side[dst]).sum() >= cut_before:
                side[a[:m][gain]], side[b[:m][gain]] = True, False
                break
        split(nodes[side], left, first)
        split(nodes[~side], parts - left, first + left)

    split(np.arange(n), n_parts, 0)
    return label


class Router:
    """Softmax regression from a vector to the parts where its neighbours lie."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 0, rounds: int = 60, rate: float = 0.1) -> None:
        rng = np.random.default_rng(seed)
        d, m = x.shape[1] + 1, target.shape[1]
        self.w = np.zeros((d, m))
        x1 = np.c_[x, np.ones(len(x))]
        first, second, step = np.zeros_like(self.w), np.zeros_like(self.w), 0
        for _ in range(rounds):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 1024):
                b = order[i:i + 1024]
                g = x1[b].T @ (self._soft(x1[b] @ self.w) - target[b]) / len(b) + 1e-5 * self.w
                step += 1
                first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
                self.w -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)

    @staticmethod
    def _soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def ranked(self, x: np.ndarray) -> np.ndarray:
        """Parts by falling probability, ties by number."""
        return np.argsort(-(x @ self.w[:-1] + self.w[-1]), axis=1, kind="stable")


class Index:
    """What is fitted: the router and how many parts a query tries."""

    def __init__(self, sample: np.ndarray, k: int = NEIGHBOURS, target_recall: float = TARGET_RECALL, seed: int = 0) -> None:
        n = len(sample)
        self.n_parts = int(min(MAX_PARTS, n // PART_ROWS)) if n >= 2 * PART_ROWS else max(1, n // SMALL_PART)
        self.router, self.probes, k = None, 1, min(k, n - 1)
        if self.n_parts == 1:
            return
        near = np.empty((n, k), np.int64)
        for i in range(0, n, 1024):
            s = sample[i:i + 1024] @ sample.T
            s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
            near[i:i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        label = balanced_parts(near, self.n_parts, seed)
        target = np.eye(self.n_parts)[label[near]].mean(axis=1) * 0.5 + np.eye(self.n_parts)[label] * 0.5
        self.router = Router(sample, target, seed)
        ranked = self.router.ranked(sample)
        place = np.argsort(ranked, axis=1)  # of each part in a row's ranking
        at = np.take_along_axis(place, ranked[near, 0], axis=1)
        found = [(at < p).mean() for p in range(1, self.n_parts + 1)]
        self.probes = int(np.argmax(np.array(found) >= min(target_recall, found[-1]))) + 1

    def parts(self, x: np.ndarray) -> np.ndarray:
        """The parts that each row's query tries, likeliest first; the first one is the row's own."""
        if self.router is None:
            return np.zeros((len(x), 1), np.int64)
        return self.router.ranked(x)[:, : self.probes]


def usable(v: Column, dim: int | None = None) -> Column:
    """Whether a vector takes part: not null, finite throughout and not zero."""
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    fine = fine if dim is None else fine & (F.size(v) == dim)
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row, each summed in one fixed order, so equal vectors score alike anywhere."""
    return np.multiply(a, b).sum(axis=1)


def best_of(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best other rows of a block: (query's place, row's place, score), ties to smaller ids."""
    s = q @ x.T
    s[q_ids[:, None] == x_ids[None, :]] = -np.inf
    if s.shape[1] > k:
        least = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        i, j = np.nonzero(s >= (least - 1e-9 * (1 + np.abs(least)))[:, None])
    else:
        i, j = np.nonzero(s > -np.inf)
    fine = s[i, j] > -np.inf
    i, j = i[fine], j[fine]
    score = np.empty(len(i))
    for at in range(0, len(i), 65536):
        score[at:at + 65536] = exact_scores(q[i[at:at + 65536]], x[j[at:at + 65536]])
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    rank = np.arange(len(i)) - np.searchsorted(i, i)
    keep = rank < k
    return i[keep], j[keep], score[keep]


def nearest(vectors: DataFrame, queries: Column, k: int = NEIGHBOURS, key: str = "vec_id", vector: str = "embedding", sample_rows: int = SAMPLE) -> DataFrame:
    """The k rows of largest inner product found for every row that `queries` selects, itself apart.

    Returns (query_id, rank from 1, vec_id, score in double precision), ties to the smaller id. Vectors
    that are null, zero, or hold null or non-finite components take no part, nor do those of another
    length than most have, nor rows with a null id; of rows that repeat an id one takes part. The fit uses
    sample_rows rows at most, by a hash of their id; every row is indexed. A part is dealt into
    blocks of about BLOCK_ROWS rows, so a part that copies of one vector fill is many tasks. An
    empty table gives an empty result. Other columns are left out.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    most = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    out = "query_id long, vec_id long, score double"
    if most is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = most.d
    v = v.where(F.size("v") == dim).dropDuplicates(["id"])
    rows = v.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
    index = Index(_matrix(rows, dim), k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = index.parts(_matrix(b.column(1), dim))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(list(p), pa.list_(pa.int32()))], ["id", "v", "asks", "parts"])

    placed = materialize(v.mapInArrow(place, "id long, v array<double>, asks boolean, parts array<int>"), "placed")
    sizes = placed.groupBy(F.col("parts")[0].alias("part")).count().withColumn("n", F.ceil(F.col("count") / BLOCK_ROWS).cast("int"))
    sizes = F.broadcast(sizes.select("part", "n"))  # MAX_PARTS rows at most
    own = placed.select(F.col("parts")[0].alias("part"), "id", "v").join(sizes, "part")
    own = own.select("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int").alias("block"), "id", "v", F.lit(False).alias("asks"))
    asked = placed.where("asks").select(F.explode("parts").alias("part"), "id", "v").join(sizes, "part")
    asked = asked.select("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "id", "v", F.lit(True).alias("asks"))

    def score(t: pa.Table) -> Iterator[pa.RecordBatch]:
        asks = t.column("asks").to_numpy()
        ids, x = t.column("id").to_numpy(), _matrix(t.column("v").combine_chunks(), dim)
        q_ids, q, x_ids, x = ids[asks], x[asks], ids[~asks], x[~asks]
        got = [pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})]
        for at in range(0, len(q) if len(x) else 0, QUERY_ROWS):
            i, j, s = best_of(q[at:at + QUERY_ROWS], x, q_ids[at:at + QUERY_ROWS], x_ids, k)
            got.append(pa.table({"query_id": q_ids[at:at + QUERY_ROWS][i], "vec_id": x_ids[j], "score": s}))
        return pa.concat_tables(got)

    found = own.unionAll(asked).groupBy("part", "block").applyInArrow(score, out)
    # Spark keeps k rows a query and task before the exchange (WindowGroupLimit), so little moves.
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
