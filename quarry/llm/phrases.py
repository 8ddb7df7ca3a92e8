"""Phrase collocations: n-gram counts from word-id suffix arrays, merged by key.

Every batch of documents sorts the suffixes of its word ids by prefix doubling, as deep as
the longest phrase; runs of suffixes whose common prefixes reach k words are the LCP
intervals, and their widths the counts of the k-word phrases. Two rounds keep the work to
what can still be frequent. In the first, batches send the hashes and counts of their words
and word pairs to hash ranges, which add them up and answer which are frequent in all, and
which batch shall name them. In the second, longer phrases are counted only along runs of
frequent pairs, since no phrase is more frequent than a pair in it, and are merged by
their text. All that follows works on frequent phrases alone.

Words and pairs are told apart by hashes of 64 bits: of n different ones, n * n / 2**65
pairs are expected to agree by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.ngrams import Merged, bits_blob, bits_of, by_range, counts_blob, counts_of, deal, ends_of, longer, opened, runs, texts_of
from quarry.llm.substring import _mix, _range_of, word_hashes

#: Bytes between words, and those that also end a piece.
_BLANK, _STOP = b" \t", b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(_BLANK)] = 1
_CLASS[list(_STOP)] = 2


class _Words:
    """The words of a batch: bytes, bounds, hashes by language, how many of the piece follow, and each word's language."""

    def __init__(self, t: pa.Table):
        langs = t.column("lang").to_pylist()
        self.langs = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.langs)}
        texts = texts_of(t.column("text"))
        self.data, ends = ends_of(texts)
        kind = _CLASS[self.data]
        edge = np.diff(np.r_[1, (kind > 0).astype(np.int8), 1])
        self.starts, self.ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        n = len(self.starts)
        self.lang = np.repeat(np.array([code[x] for x in langs], np.int32), np.diff(np.r_[0, np.searchsorted(self.starts, ends)]))
        salt = _mix(word_hashes(*_bytes_of(self.langs)) if self.langs else np.zeros(0, np.uint64))
        self.hash = word_hashes(self.data, self.starts, self.ends) if n else np.zeros(0, np.uint64)
        self.hash = longer(salt[self.lang], self.hash) if n else self.hash
        piece = np.cumsum(kind == 2)[self.starts] if n else np.zeros(0, np.int64)
        self.joined = np.r_[piece[1:] == piece[:-1], False] if n else np.zeros(0, bool)  # the next word follows in the piece

    def phrase(self, i: int, k: int) -> str:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[i:i + k].tolist(), self.ends[i:i + k].tolist())).decode("utf-8", "replace")


def _bytes_of(langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The languages as words to hash (the empty one too)."""
    b = [b"=" + x.encode() for x in langs]
    ends = np.cumsum([len(x) for x in b])
    return np.frombuffer(b"".join(b), np.uint8), ends - np.array([len(x) for x in b]), ends


def suffix_counts(ids: np.ndarray, joined: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phrases of 1 to `longest` words: for each length one start per distinct phrase and its count.

    ids are word ids from 0, joined[i] tells whether word i + 1 follows word i in a piece.
    Suffixes are ranked by 1, 2, 4 ... words (prefix doubling), then cut where the common
    prefix of neighbours is shorter than a phrase (LCP intervals).
    """
    n = len(ids)
    if not n:
        return [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * longest
    stop = np.flatnonzero(~joined)
    rest = stop[np.searchsorted(stop, np.arange(n))] - np.arange(n) + 1  # words up to the end of the piece
    rank, depth = ids.astype(np.int64) + 1, 1
    while depth < longest:
        after = np.zeros(n, np.int64)
        after[:max(n - depth, 0)] = rank[depth:]
        after[rest <= depth] = 0  # the piece is over: before all words
        key = rank * (int(rank.max()) + 1) + after
        _, rank = np.unique(key, return_inverse=True)
        rank = rank + 1
        depth *= 2
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, np.int64)  # words that a suffix shares with the one before it in the order
    alike = np.ones(n - 1, bool)
    for k in range(longest):
        a, b = order[:-1] + k, order[1:] + k
        alike = alike & (rest[order[:-1]] > k) & (rest[order[1:]] > k)
        alike[alike] = ids[a[alike]] == ids[b[alike]]
        common[1:] += alike
    found = []
    for k in range(1, longest + 1):
        whole = rest[order] >= k
        first = np.flatnonzero((common < k) & whole)  # an interval's suffixes stand together, all as long as k
        number = np.cumsum(whole)
        ends = np.r_[first[1:], n]
        count = number[ends - 1] - number[first] + 1
        found.append((order[first], count))
    return found


def _counted(w: _Words) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Word ids, and for words and pairs: sorted hashes, counts and one start of each."""
    _, ids = np.unique(w.hash, return_inverse=True)
    out = []
    for k, (start, count) in enumerate(suffix_counts(ids, w.joined, 2), 1):
        h = w.hash[start] if k == 1 else longer(w.hash[start], w.hash[start + 1])
        order = np.argsort(h)
        out.append((h[order], count[order], start[order]))
    return ids, out


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30) -> DataFrame:
    """(lang, phrase, k, f, n): phrases of 1 to `longest` words that a language's texts hold `least` times or more.

    A-Z is in lower case; texts are split at `[.,;:!?\\x0A-\\x0D]` into pieces and those at
    blanks and tabs into words; phrases lie within a piece and are joined by one space. f
    counts all places, overlaps too, n all words of the language. Null texts are empty, a null
    language is `und`; other columns are left out. docs is read several times, in the same order.
    """
    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    dealt, n_ranges = deal(source, "text")

    def count(t: pa.Table) -> pa.Table:
        batch, rows = t.column("batch")[0].as_py(), {"batch": [], "order": [], "range": [], "run": [], "counts": []}
        for k, (h, c, _) in enumerate(_counted(_Words(opened(t)))[1], 1):
            full, where, packed = runs(h, n_ranges)
            for name, values in zip(rows, ([batch] * len(full), [k] * len(full), full, packed, [counts_blob(c[w]) for w in where])):
                rows[name] += values
        return pa.table(rows, schema=pa.schema([("batch", pa.int64()), ("order", pa.int32()), ("range", pa.int32()), ("run", pa.binary()), ("counts", pa.binary())]))

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        m = Merged(t)
        total = m.split(np.where(m.totals >= least, m.totals, 0))
        named = [counts_blob(np.where(o, x, 0)[x > 0]) for x, o in zip(total, m.split(m.owner))]  # of frequent ones: the total, in the batch that names it
        return pa.table({"batch": t.column("batch"), "order": t.column("order"), "range": t.column("range"), "frequent": pa.array([bits_blob(x > 0) for x in total], pa.binary()), "total": pa.array(named, pa.binary())})

    def name(t: pa.Table, answers: pa.Table) -> pa.Table:
        w = _Words(opened(t))
        ids, counted = _counted(w)
        out: list[tuple] = []
        frequent = {}
        for k, (h, _, start) in enumerate(counted, 1):
            at = _range_of(h, n_ranges)
            ok, total = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
            for o, i, bits, blob in zip(*[answers.column(c).to_pylist() for c in ("order", "range", "frequent", "total")]):
                if o == k:
                    ok[at[i]:at[i + 1]] = bits_of(bits, int(at[i + 1] - at[i]))
                    mine = at[i] + np.flatnonzero(ok[at[i]:at[i + 1]])
                    total[mine] = counts_of(blob, len(mine))
            for i in np.flatnonzero(total).tolist():
                out.append((int(w.lang[start[i]]), w.phrase(int(start[i]), k), k, int(total[i])))
            frequent[k] = h[ok]
        n = len(ids)
        if n and longest > 2:
            pair = np.zeros(n, bool)
            at = np.flatnonzero(w.joined)
            h = longer(w.hash[at], w.hash[at + 1])
            where = np.minimum(np.searchsorted(frequent[2], h), max(len(frequent[2]) - 1, 0))
            pair[at] = frequent[2][where] == h if len(frequent[2]) else False
            held = np.flatnonzero(pair | np.r_[False, pair[:-1]])  # words of runs of frequent pairs
            for k, (start, c) in enumerate(suffix_counts(ids[held], pair[held], longest), 1):
                if k > 2:
                    out += [(int(w.lang[i]), w.phrase(i, k), k, m) for i, m in zip(held[start].tolist(), c.tolist())]
        words = np.bincount(w.lang, minlength=len(w.langs)).tolist()
        out += [(i, None, 0, m) for i, m in enumerate(words)]
        code, phrase, k, f = zip(*out) if out else ((), (), (), ())
        return pa.table([pa.array([w.langs[i] for i in code], pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(f, pa.int64())], names=["lang", "phrase", "k", "f"])

    answers = by_range(dealt.groupBy("batch").applyInArrow(count, "batch long, order int, range int, run binary, counts binary"), n_ranges)
    answers = answers.groupBy("order", "range").applyInArrow(answer, "batch long, order int, range int, frequent binary, total binary")
    named = dealt.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(name, "lang string, phrase string, k int, f long")
    named = materialize(named.groupBy("lang", "phrase", "k").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("k") == 0)), "phrases")
    words = named.where("k = 0").select("lang", F.col("f").alias("n"))
    return named.where(f"k between 1 and {longest}").join(words, "lang").select("lang", "phrase", "k", "f", "n")


def _exact(c: str) -> Column:
    return F.col(c).cast("decimal(20,0)")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 4, least: int = 30, scale: int = 2_000_000, part_of_pct: int = 80, top: int = 2000) -> DataFrame:
    """Each language's `top` phrases of 2 to `longest` words whose parts mostly come together.

    A phrase found a times is cut after each word k; l and r count the two parts, and its
    score is floor(scale * a / (l + r)) of its weakest cut (of equals the first). Phrases that
    lie in a longer one found part_of_pct percent as often, or more, are dropped. Returns
    (lang, rank, phrase, a, l, r, n, score) by score and a descending and phrase ascending.
    Texts, nulls and languages are as in `phrase_counts`; an empty table gives an empty one.
    """
    found = materialize(phrase_counts(docs, text, lang, longest, least), "counts")
    c = found.where("k > 1").withColumn("w", F.split("phrase", " "))
    k = F.col("k")
    sides = F.flatten(F.transform(F.sequence(F.lit(1), k - 1), lambda i: F.array(
        F.struct(i.alias("cut"), F.lit(0).alias("side"), F.array_join(F.slice("w", 1, i), " ").alias("part")),
        F.struct(i.alias("cut"), F.lit(1).alias("side"), F.array_join(F.slice("w", i + 1, k - i), " ").alias("part")))))
    parts = c.select("lang", "phrase", "n", F.col("f").alias("a"), F.inline(sides))
    parts = parts.join(found.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    cuts = parts.groupBy("lang", "phrase", "n", "a", "cut").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    score = F.expr(f"({scale}BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").cast("long")
    scored = cuts.groupBy("lang", "phrase", "n", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("x")).select("lang", "phrase", "n", "a", "x.score", "x.l", "x.r")

    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    holds = c.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(holds, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * _exact("longer") < part_of_pct * _exact("a")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return kept.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
