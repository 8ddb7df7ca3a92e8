"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Documents are dealt into batches of neighbouring keys, so "starts earlier" is the
order of batches and, within one, of keys and positions. Every batch hashes all its
windows, drops its own repeats and sends one sorted run of hashes to each hash range.
A hash range merges its runs and answers each with one bit per hash: whether an
earlier batch has it. Batches then hash their texts again, mark the windows that
start earlier somewhere, and merge them into maximal removal intervals. So 6 to 8
bytes a window cross the network once and a bit comes back; a passage that a billion
documents share counts once per batch.

Hashes have 64 bits; of n different windows, n * n / 2**65 pairs are expected to
agree by chance (below one in a thousand runs for 10**8 windows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import partitions_for

#: Bytes of text that a batch is meant to hold, and that one hash range is meant to answer for.
BATCH_BYTES = 4 << 20
RANGE_BYTES = 8 << 20
#: A document counts for one more unit of its batch's size for each so many bytes.
UNIT_BYTES = 4096
#: Bytes whose polynomial is summed at once.
SEGMENT = 1 << 18

#: Odd multipliers of the byte and the word polynomial, and their inverses modulo 2**64.
_BYTE = 0x9E3779B97F4A7C15
_WORD = 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    x = np.full(n, base & (1 << 64) - 1, np.uint64)
    if n:
        x[0] = 1
    return np.multiply.accumulate(x) if n else x


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of x over all bits (one to one)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(32)
    x = x * np.uint64(0xE9846AF9B1A615D)
    return x ^ (x >> np.uint64(28))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word, as a difference of prefix sums of byte * B**i that an inverse power shifts to a common origin."""
    word = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # segments keep the tables of powers short, whatever a text's length
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, side="right")))
        lo, hi = starts[at], ends[to - 1]
        prefix = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((data[lo:hi].astype(np.uint64) + np.uint64(1)) * _powers(_BYTE, hi - lo), out=prefix[1:])
        a, b = starts[at:to] - lo, ends[at:to] - lo
        word[at:to] = _mix((prefix[b] - prefix[a]) * _powers(pow(_BYTE, -1, 1 << 64), hi - lo)[a] + (b - a).astype(np.uint64))
        at = to
    return word


def window_hashes(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in order: every window's hash, the index of its first word, and each text's number of words.

    Rolling in both steps: a window's hash is a difference of prefix sums of word * A**j, as a word's is one of bytes.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    word = word_hashes(data, starts, ends)
    text_ends = np.cumsum(lengths + 1)
    n_words = np.diff(np.r_[0, np.searchsorted(starts, text_ends)])
    n = len(word)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word * _powers(_WORD, n), out=total[1:])
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), n_words
    h = _mix((total[window:] - total[:-window]) * _powers(pow(_WORD, -1, 1 << 64), n - window + 1))
    first = np.arange(n - window + 1)
    text_of = np.repeat(np.arange(len(texts)), n_words)
    inside = text_of[first] == text_of[first + window - 1]
    return h[inside], first[inside], n_words


def covered(starts: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Whether each word lies in a window that starts at one of `starts`."""
    step = np.zeros(n_words + window + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step)[:n_words] > 0


def spans(mask: np.ndarray) -> list[dict]:
    """Maximal intervals [start, end) of true values."""
    edge = np.diff(np.r_[0, mask.astype(np.int8), 0])
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def _ordered(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """The order of a batch's rows that decides what is earlier, and their UTF-8 texts in it."""
    keys, texts = t.column("key").to_pylist(), [(x or "").encode("utf-8", "surrogatepass") for x in t.column("text").to_pylist()]
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] if keys[i] is not None else 0, texts[i]))
    return np.array(order, np.int64), [texts[i] for i in order]


def _unique(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct window hashes sorted, each window's place among them, whether it is the batch's first, its first word, words per text."""
    h, first, n_words = window_hashes(texts, window)
    u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    is_first = np.zeros(len(h), bool)
    is_first[at] = True
    return u, inverse, is_first, first, n_words


def _range_of(u: np.ndarray, n_ranges: int) -> np.ndarray:
    """Sorted hashes are cut where a new range starts: n_ranges + 1 positions."""
    cuts = np.array([(i << 64) // n_ranges for i in range(1, n_ranges)], np.uint64)
    return np.r_[0, np.searchsorted(u, cuts), len(u)]


def _pack(u: np.ndarray) -> bytes:
    """A sorted run as its first value and its gaps, each in as few bytes as the widest gap needs."""
    if not len(u):
        return b""
    gap = np.diff(u, prepend=u[:1])
    gap[0] = 0
    width = max(1, (int(gap.max()).bit_length() + 7) // 8)
    return bytes([width]) + u[:1].tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpack(b: bytes) -> np.ndarray:
    if not b:
        return np.zeros(0, np.uint64)
    width = b[0]
    raw = np.frombuffer(b, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :width] = raw
    gap = wide.view(np.uint64).ravel()
    gap[0] = np.frombuffer(b, np.uint64, 1, 1)[0]
    return np.cumsum(gap, dtype=np.uint64)


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """Remove every word that a window of `window` words covers whose word sequence also starts earlier.

    Earlier is a smaller key, or the same document and a smaller position; windows are
    judged on the input. Returns (key, n_words, n_removed, kept_text, removed): what stays
    joined by single spaces, and the maximal intervals [start, end) of removed words. The
    columns of `keep` follow, each row with its own; their names must differ from those.

    The key is an integer column. Null and empty texts have no words and an empty kept_text. A row with a null key
    comes before all others; rows that repeat a key come in the order of their texts,
    so of equal rows the first stays. An empty table gives an empty result. Columns
    that are not in `keep` are left out.
    """
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    through = [c for c in keep if c != text]  # the text goes along anyway
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(through)])
    units = F.sequence(F.lit(0), (F.coalesce(F.octet_length("text"), F.lit(0)) / UNIT_BYTES).cast("int"))
    size = source.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n_batches = max(1, -(-size // BATCH_BYTES))
    n_ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    # Batches end at quantiles of the keys, weighed by bytes; their number is a few for each task.
    cuts = source.select("key", F.explode(units)).select(F.percentile_approx("key", [i / n_batches for i in range(1, n_batches)] or [0.5], max(10_000, 20 * n_batches))).first()[0] or []
    cuts = np.array(sorted(set(cuts)) if n_batches > 1 else [], np.int64)

    @F.pandas_udf(T.IntegerType())
    def batch_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, k.to_numpy(np.int64), side="left").astype(np.int32))

    n_tasks = partitions_for(spark, size, 32 << 20)
    dealt = source.withColumn("batch", batch_of(F.coalesce(F.col("key").cast("long"), F.lit(-(1 << 63))))).repartition(n_tasks, "batch")

    def hashes(t: pa.Table) -> pa.Table:
        _, texts = _ordered(t)
        u = _unique(texts, window)[0]
        at = _range_of(u, n_ranges)
        full = [i for i in range(n_ranges) if at[i + 1] > at[i]]
        return pa.table({"batch": pa.array([t.column("batch")[0].as_py()] * len(full), pa.int32()), "range": pa.array(full, pa.int32()), "run": pa.array([_pack(u[at[i]:at[i + 1]]) for i in full], pa.binary())})

    def answer(t: pa.Table) -> pa.Table:
        t = t.sort_by("batch")
        runs = [_unpack(x.as_py()) for x in t.column("run")]
        h = np.concatenate(runs)
        order = np.argsort(h, kind="stable")
        s = h[order]
        later = np.zeros(len(h), bool)
        later[order[1:]] = s[1:] == s[:-1]
        ends = np.cumsum([len(r) for r in runs])
        bits = [np.packbits(x).tobytes() for x in np.split(later, ends[:-1])]
        return pa.table({"batch": t.column("batch"), "range": t.column("range"), "bits": pa.array(bits, pa.binary())})

    runs = dealt.groupBy("batch").applyInArrow(hashes, "batch int, range int, run binary")
    bits = runs.repartition(n_ranges, "range").groupBy("range").applyInArrow(answer, "batch int, range int, bits binary")

    out = T.StructType([
        T.StructField(key, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType()),
        T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        *[T.StructField(c, T.StringType() if c == text else docs.schema[c].dataType) for c in keep],
    ])

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        order, texts = _ordered(left)
        left = left.take(pa.array(order))
        u, inverse, is_first, first, n_words = _unique(texts, window)
        at = _range_of(u, n_ranges)
        earlier = np.zeros(len(u), bool)
        for i, b in zip(right.column("range").to_pylist(), right.column("bits").to_pylist()):
            earlier[at[i]:at[i + 1]] = np.unpackbits(np.frombuffer(b, np.uint8), count=int(at[i + 1] - at[i])).astype(bool)
        gone = covered(first[earlier[inverse] | ~is_first], int(n_words.sum()), window)
        ends = np.cumsum(n_words)
        kept, removed, n_removed = [], [], []
        for x, a, b in zip(texts, (ends - n_words).tolist(), ends.tolist()):
            mask = gone[a:b]
            found = x.split()
            if mask.any():
                found = [w for w, g in zip(found, mask.tolist()) if not g]
                removed.append(spans(mask))
            else:
                removed.append([])
            n_removed.append(b - a - len(found))
            kept.append(b" ".join(found).decode("utf-8", "surrogatepass"))
        found = [left.column("key"), pa.array(n_words), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
        return pa.Table.from_arrays([*found, *[left.column("text" if c == text else f"keep{through.index(c)}") for c in keep]], names=out.names)

    return dealt.groupBy("batch").cogroup(bits.groupBy("batch")).applyInArrow(remove, out)
