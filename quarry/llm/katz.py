"""Language-model scoring by Katz backoff.

p(w | h) is d(c) * c(hw) / c(h) where hw was seen, else backoff(h) * p(w | h without its
first word), down to single words; what no training text holds is one unknown word. d is the
Good-Turing discount by the counts of counts of each order. The backoff weight is the mass
that discounting leaves a context over the mass that the shorter context gives to words not
seen after it, so the probabilities after every context add up to one.

The counts are tables cut by order and hash range. Batches of documents send each range
the sorted hashes of their n-grams with the counts of training texts and get the totals
back. A context that one batch alone holds is normalised there; for the others each n-gram's
first batch adds its share to the context's row in a second table, and batches that back off
from it get the weight. No text that was trained on backs off, so contexts that no other
text holds need no weight. Then every batch evaluates its tokens, all orders at
once, from the shortest up. So a frequent n-gram costs one entry a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.ngrams import Merged, bits_blob, bits_of, by_range, counts_blob, counts_of, deal, ends_of, floats_blob, floats_of, longer, opened, runs, texts_of
from quarry.llm.substring import _pack, _range_of, _unpack, word_bounds, word_hashes

#: Counts up to this are discounted by Good-Turing; larger ones lose as many as this one does.
KATZ = 5
#: What a text begins and ends with.
_START, _END = np.uint64(0x5354415254), np.uint64(0x454E44)
#: Counts of counts 1 to KATZ + 1, tokens, distinct words.
_STATS = KATZ + 3


def discounts(stats: np.ndarray) -> np.ndarray:
    """d for the counts 0 to KATZ, by the counts of counts 1 to KATZ + 1.

    Katz's d = (r* / r - m) / (1 - m) with r* = (r + 1) n(r + 1) / n(r) and
    m = (KATZ + 1) n(KATZ + 1) / n(1). Where the counts of counts are too uneven for a d
    between 0 and 1 it is 1 - D / r with D = n(1) / (n(1) + 2 n(2)), or 1/2 where that is 0 or 1.
    """
    n = np.r_[0.0, stats[:KATZ + 1].astype(float)]
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    m = (KATZ + 1) * n[KATZ + 1] / n[1] if n[1] else 1.0
    d = np.ones(KATZ + 1)
    for r in range(1, KATZ + 1):
        good = ((r + 1) * n[r + 1] / (n[r] * r) - m) / (1 - m) if n[r] and m < 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - flat / r
    return d


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c. Counts beyond KATZ lose as many as KATZ does, so every context has something left for words not seen after it."""
    return np.where(c > KATZ, c - KATZ * (1 - d[KATZ]), d[np.minimum(c, KATZ)] * c)


class _Grams:
    """The n-grams of a batch: each text is a start, its words and an end."""

    def __init__(self, t: pa.Table, order: int):
        t = opened(t)
        texts = texts_of(t.column("text"))
        data, ends = ends_of(texts)
        starts, stops = word_bounds(data)
        n_words = np.diff(np.r_[0, np.searchsorted(starts, ends)])
        size = n_words + 2
        self.last = np.cumsum(size) - 1
        self.first = self.last - size + 1
        word = np.ones(int(size.sum()), bool)
        word[self.first] = word[self.last] = False
        self.token = np.empty(len(word), np.uint64)
        self.token[word] = word_hashes(data, starts, stops) if len(starts) else 0
        self.token[self.first], self.token[self.last] = _START, _END
        self.place = np.arange(len(word)) - np.repeat(self.first, size)
        train = np.repeat(t.column("train").to_numpy().astype(bool), size)
        self.rows = t
        self.hashes, self.index, self.local, self.asked, self.at = [], [], [], [], []
        gram = self.token
        for n in range(1, order + 1):
            if n > 1:
                gram = np.r_[gram[:1], longer(gram[:-1], self.token[1:])]
            at = np.flatnonzero(self.place >= n - 1)
            u, inverse = np.unique(gram[at], return_inverse=True)
            index = np.full(len(word), -1, np.int32)
            index[at] = inverse
            self.hashes.append(u)
            self.index.append(index)
            self.local.append(np.bincount(inverse, train[at], len(u)).astype(np.int64))
            self.asked.append(np.bincount(inverse, ~train[at], len(u)) > 0)  # some text that wasn't trained on has it
            self.at.append(at)

    def parts(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For every n-gram of n words the index of its context and of the n-gram without its first word."""
        at, index = self.at[n - 1], self.index
        context, suffix = np.zeros(len(self.hashes[n - 1]), np.int32), np.zeros(len(self.hashes[n - 1]), np.int32)
        context[index[n - 1][at]] = index[n - 2][at - 1]
        suffix[index[n - 1][at]] = index[n - 2][at]
        return context, suffix


class _Model:
    """What a batch knows of the model: the totals of its n-grams, and its contexts' shares."""

    def __init__(self, g: _Grams, answers: pa.Table, order: int, n_ranges: int):
        self.g, self.order = g, order
        self.cuts = [_range_of(u, n_ranges) for u in g.hashes]
        self.total = [np.zeros(len(u), np.int64) for u in g.hashes]
        self.owner = [np.zeros(len(u), bool) for u in g.hashes]
        self.shared = [np.zeros(len(u), bool) for u in g.hashes]  # other batches have the n-gram as well, and someone may back off from it
        stats = None
        for row in answers.to_pylist():
            if row["owner"] is not None:
                n, at = row["order"], self.cuts[row["order"] - 1]
                a, b = at[row["range"]], at[row["range"] + 1]
                self.total[n - 1][a:b] = counts_of(row["data"], int(b - a))
                for name, bits in (("owner", self.owner), ("shared", self.shared)):
                    bits[n - 1][a:b] = bits_of(row[name], int(b - a))
                stats = row["stats"]
        self.stats = np.array(stats, np.int64).reshape(order, _STATS)
        self.d = [discounts(x) for x in self.stats]
        self.tokens, self.types = int(self.stats[0, KATZ + 1]), int(self.stats[0, KATZ + 2])
        #: the discounted probability of every n-gram that was seen
        self.p = [discounted(self.total[0], self.d[0]) / max(self.tokens, 1)]
        self.context, self.suffix = [None], [None]
        for n in range(2, order + 1):
            context, suffix = g.parts(n)
            self.context.append(context)
            self.suffix.append(suffix)
            self.p.append(discounted(self.total[n - 1], self.d[n - 1]) / np.maximum(self.total[n - 2][context], 1))

    def unknown(self) -> float:
        """What single words leave to the unknown one: all that their discounts take."""
        if not self.tokens:
            return 1.0
        n, d = self.stats[0], self.d[0]
        few = sum((1 - d[r]) * r * float(n[r - 1]) for r in range(1, KATZ + 1))
        many = KATZ * (1 - d[KATZ]) * float(self.types - n[:KATZ].sum())
        return (few + many) / self.tokens

    def shares(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For contexts of n - 1 words, over the n-grams that this batch owns: counts taken by the discounts, and the shorter context's probability."""
        mine, size = self.owner[n - 1], len(self.g.hashes[n - 2])
        c = self.total[n - 1][mine]
        taken = np.bincount(self.context[n - 1][mine], c - discounted(c, self.d[n - 1]), size)
        shorter = np.bincount(self.context[n - 1][mine], self.p[n - 2][self.suffix[n - 1][mine]], size)
        return taken, shorter

    def wanted(self, n: int) -> np.ndarray:
        """Contexts of n - 1 words, seen in training, that some token of this batch backs off from."""
        want = np.zeros(len(self.g.hashes[n - 2]), bool)
        want[self.context[n - 1][self.total[n - 1] == 0]] = True
        return want & (self.total[n - 2] > 0)


_RIGHT = "batch long, order int, range int, data binary, owner binary, shared binary, stats array<long>"


def katz_scores(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", order: int = 2) -> DataFrame:
    """log10 of every whole text's probability by an n-gram model of the rows where `train` holds.

    A-Z is in lower case; tokens are the words and one end. Returns (key, trained, n_tokens,
    n_known, train_tokens, train_types, base_score, score): n_known tokens occur in training
    texts, train_tokens and train_types count all and distinct ones there, and base_score has
    c + 0.1 over train_tokens + 0.1 * (train_types + 1) for each token.

    Null texts are empty: an end alone. A null `train` is false, and without training texts
    every token is the unknown word, with probability 1. Rows that repeat a key are scored
    each; an empty table gives an empty result; other columns are left out. docs is read
    several times and must come in the same order, as a table does.
    """
    kind = docs.schema[key].dataType
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    dealt, n_ranges = deal(source, "text")

    def count(t: pa.Table) -> pa.Table:
        g, batch = _Grams(t, order), t.column("batch")[0].as_py()
        rows: dict[str, list] = {"batch": [], "order": [], "range": [], "run": [], "counts": [], "asked": []}
        for n in range(1, order + 1):
            full, where, packed = runs(g.hashes[n - 1], n_ranges)
            for name, values in zip(rows, ([batch] * len(full), [n] * len(full), full, packed, [counts_blob(g.local[n - 1][w]) for w in where], [bits_blob(g.asked[n - 1][w]) for w in where])):
                rows[name] += values
        return pa.table(rows, schema=pa.schema([("batch", pa.int64()), ("order", pa.int32()), ("range", pa.int32()), ("run", pa.binary()), ("counts", pa.binary()), ("asked", pa.binary())]))

    def total(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        m = Merged(t)
        asked = m.any(np.concatenate([bits_of(x.as_py(), n) for x, n in zip(t.column("asked"), m.sizes)]))
        n, at = t.column("order")[0].as_py(), t.column("range")[0].as_py()
        c = m.sums[(m.sums > 0) & ((m.distinct != _START) | (n > 1))]
        own = [int((c == r).sum()) for r in range(1, KATZ + 2)] + [int(c.sum()), len(c)]
        stats = [0] * ((n - 1) * _STATS) + own + [0] * ((order - n) * _STATS)
        size = len(m.sizes)
        blobs = ([*map(blob, m.split(x)), None] for blob, x in ((counts_blob, m.totals), (bits_blob, m.owner), (bits_blob, m.shared & asked)))
        return pa.table([
            pa.array([*t.column("batch").to_pylist(), -1], pa.int64()), pa.array([n] * (size + 1), pa.int32()), pa.array([at] * (size + 1), pa.int32()),
            *[pa.array(x, pa.binary()) for x in blobs], pa.array([None] * size + [stats], pa.list_(pa.int64())),
        ], names=["batch", "order", "range", "data", "owner", "shared", "stats"])

    def share(t: pa.Table, answers: pa.Table) -> pa.Table:
        m, batch = _Model(_Grams(t, order), answers, order, n_ranges), t.column("batch")[0].as_py()
        rows: dict[str, list] = {"batch": [], "order": [], "range": [], "run": [], "taken": [], "shorter": [], "want": []}
        for n in range(2, order + 1):
            taken, shorter = m.shares(n)
            want, shared, at = m.wanted(n), m.shared[n - 2], m.cuts[n - 2]
            for i in range(n_ranges):
                a, b = int(at[i]), int(at[i + 1])
                sent = a + np.flatnonzero(shared[a:b] & (want[a:b] | (taken[a:b] > 0)))
                if len(sent):
                    for name, value in zip(rows, (batch, n, i, _pack(m.g.hashes[n - 2][sent]), floats_blob(taken[sent]), floats_blob(shorter[sent]), bits_blob(want[sent]))):
                        rows[name].append(value)
        return pa.table(rows, schema=pa.schema([("batch", pa.int64()), ("order", pa.int32()), ("range", pa.int32()), *[(c, pa.binary()) for c in ("run", "taken", "shorter", "want")]]))

    def weigh(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        keys = [_unpack(x.as_py()) for x in t.column("run")]
        taken, shorter = (np.concatenate([floats_of(x.as_py(), len(k)) for x, k in zip(t.column(c), keys)]) for c in ("taken", "shorter"))
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        weight = np.bincount(inverse, taken) / (1 - np.bincount(inverse, shorter))  # times 1 / c(h), which the batch knows
        want = [bits_of(x.as_py(), len(k)) for x, k in zip(t.column("want"), keys)]
        data = [floats_blob(x[w]) for x, w in zip(np.split(weight[inverse], np.cumsum([len(k) for k in keys])[:-1]), want)]
        keep = pa.array([bool(w.any()) for w in want])
        return pa.table({"batch": t.column("batch"), "order": t.column("order"), "range": t.column("range"), "data": pa.array(data, pa.binary())}).filter(keep)

    out = T.StructType([
        T.StructField(key, kind), T.StructField("trained", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "train_tokens", "train_types")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def score(t: pa.Table, right: pa.Table) -> pa.Table:
        g = _Grams(t, order)
        m = _Model(g, right, order, n_ranges)
        weights = {(r["order"], r["range"]): r["data"] for r in right.select(["order", "range", "data", "owner"]).to_pylist() if r["owner"] is None}
        at = np.flatnonzero(g.place >= 1)
        word = g.index[0][at]
        c = m.total[0][word]
        with np.errstate(divide="ignore"):
            logp = np.log10(np.where(c > 0, m.p[0][word], m.unknown()))
            base = np.log10((c + 0.1) / (m.tokens + 0.1 * (m.types + 1)))
            for n in range(2, order + 1):
                taken, shorter = m.shares(n)
                weight = np.divide(taken, 1 - shorter, out=np.ones(len(taken)), where=~m.shared[n - 2] & m.wanted(n))
                sent = m.shared[n - 2] & m.wanted(n)
                for i in range(n_ranges):
                    if (n, i) in weights:
                        a, b = int(m.cuts[n - 2][i]), int(m.cuts[n - 2][i + 1])
                        here = a + np.flatnonzero(sent[a:b])
                        weight[here] = floats_of(weights[n, i], len(here))
                backoff = np.log10(weight / np.maximum(m.total[n - 2], 1))
                gram, context = g.index[n - 1][at], g.index[n - 2][at - 1]
                has = gram >= 0
                seen = has & (m.total[n - 1][np.maximum(gram, 0)] > 0)
                known = has & (m.total[n - 2][np.maximum(context, 0)] > 0)
                logp = np.where(seen, np.log10(m.p[n - 1][np.maximum(gram, 0)]), logp + np.where(known, backoff[np.maximum(context, 0)], 0.0))
        row = np.searchsorted(g.first, at, side="right") - 1
        n_rows = g.rows.num_rows
        size = np.bincount(row, minlength=n_rows)
        return pa.Table.from_arrays([
            g.rows.column("key"), g.rows.column("train"), pa.array(size, pa.int64()), pa.array(np.bincount(row, c > 0, n_rows).astype(np.int64)),
            pa.array(np.full(n_rows, m.tokens), pa.int64()), pa.array(np.full(n_rows, m.types), pa.int64()),
            pa.array(np.bincount(row, base, n_rows)), pa.array(np.bincount(row, logp, n_rows)),
        ], names=out.names)

    counted = by_range(dealt.groupBy("batch").applyInArrow(count, "batch long, order int, range int, run binary, counts binary, asked binary"), n_ranges)
    totals = counted.groupBy("order", "range").applyInArrow(total, _RIGHT)
    stats = totals.where("batch = -1").agg(F.array(*[F.sum(F.col("stats")[i]) for i in range(order * _STATS)]).alias("stats"))
    answers = totals.where("batch >= 0").drop("stats").crossJoin(F.broadcast(stats))  # one row
    if order > 1:
        shares = by_range(dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(share, "batch long, order int, range int, run binary, taken binary, shorter binary, want binary"), n_ranges)
        weights = shares.groupBy("order", "range").applyInArrow(weigh, "batch long, order int, range int, data binary")
        answers = answers.unionByName(weights, allowMissingColumns=True)
    return dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(score, out)

