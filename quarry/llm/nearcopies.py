"""Near duplicates of a Jaccard similarity by SimHash: the operator of `simhash` with wider fingerprints.

At five words and a similarity of 0.8 two texts' fingerprints differ in some 15 % of their
bits, too many for blocks of equal bits to bring a pair together. So texts meet in buckets
of MinHash bands, and in a bucket 512-bit SimHash fingerprints are compared bit-sliced:
planes stored vertically, carry-save counters, blocks abandoned once all lanes exceed the
radius. What stays is decided by the shingle sets themselves.
"""

from __future__ import annotations

import itertools
import math
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialize, numbered, slices, without
from quarry.llm.components import connected_components
from quarry.llm.substring import window_hashes

SEED = 42
BITS = 512
#: A pair meets if all ROWS values of one of BANDS bands agree: a chance of 0.9998 at similarity 0.8.
BANDS = 28
ROWS = 6
#: Members of a bucket that one task holds against each other, at most; larger buckets are dealt into such blocks.
BLOCK = 4096
#: Times that members outside their bucket's commonest group are held against two of such groups, before all pairs are compared.
ROUNDS = 2
#: Buckets of at most so many members are compared side by side, many at once.
SMALL = 64
#: Members whose prints are held against a block at once, so the pairs found at a time are bounded.
STRIP = 256
#: Members, and bytes of their texts, that one task holds against as many by their shingle sets.
TEXTS = 1024
TEXT_BYTES = 2 << 20

_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 32, BANDS * ROWS, np.uint32)
_ODD = _RNG.integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
_WIDE = _RNG.integers(0, 1 << 63, BITS // 64, np.uint64) * np.uint64(2) + np.uint64(1)


def radius_for(similarity: float) -> int:
    """The bits in which fingerprints of sets of this similarity differ at most: over five standard deviations above the mean."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(BITS * p + 5.75 * math.sqrt(BITS * p * (1 - p)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z only


def shingles(text: str | None, shingle: int) -> set[bytes]:
    """The distinct runs of `shingle` words; the whole text if it has fewer words, nothing if it has none."""
    w = _lower(text).split()
    k = min(shingle, len(w))
    return {b" ".join(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set()


def shingle_hashes(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in order: the distinct hashes of their shingles, and where each text's start (and the end)."""
    h, _, n_words = window_hashes(texts, shingle)
    count = np.where(n_words == 0, 0, np.maximum(1, n_words - shingle + 1))
    text = np.repeat(np.arange(len(texts)), count)
    all_h = np.empty(len(text), np.uint64)
    long = np.repeat(n_words >= shingle, count)
    all_h[long] = h
    all_h[~long] = [xxhash.xxh64_intdigest(b" ".join(texts[i].split()), SEED) for i in np.flatnonzero((n_words > 0) & (n_words < shingle)).tolist()]
    order = np.lexsort((all_h, text))
    h, text = all_h[order], text[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (text[1:] != text[:-1])][: len(h)]
    return h[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def minhash_bands(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A key for each band of each non-empty text, whose hashes start at starts."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    least = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for f in range(BANDS * ROWS):
        least[:, f] = np.minimum.reduceat((low ^ _XOR[f]) * _ODD[f], starts)
    keys = (_mixed(least.reshape(-1, BANDS, ROWS)) * _BAND).sum(axis=2, dtype=np.uint64)
    return _mixed(keys + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def wide_fingerprints(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """SimHash of BITS bits of each text: bit i is set if over half of the distinct shingles' values have it."""
    out = []
    wide = _mixed(h[:, None] * _WIDE).view(np.uint8) if len(h) else np.zeros((0, BITS // 8), np.uint8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        total = np.zeros(BITS, np.int32)
        for i in range(a, b, 255):  # so many add up in a byte
            total += np.unpackbits(wide[i:min(b, i + 255)], axis=1).sum(axis=0, dtype=np.uint8)
        out.append(np.packbits(total > (b - a) // 2).tobytes())
    return out


def planes(prints: np.ndarray) -> np.ndarray:
    """Fingerprints (rows of bytes) stored vertically: row p has bit p of all of them, 64 a word."""
    flat = np.zeros((-(-len(prints) // 64) * 64, BITS), np.uint8)
    flat[: len(prints)] = np.unpackbits(prints, axis=1)
    return np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view(np.uint64)


class CarrySave:
    """Vertical counters: per lane, how many of the bits that came in are set. Inputs wait until two can go through an adder."""

    def __init__(self) -> None:
        self.sums: list = []
        self.waits: list = []

    def add(self, x: np.ndarray, level: int = 0) -> None:
        if level == len(self.sums):
            self.sums.append(np.zeros_like(x))
            self.waits.append(None)
        y = self.waits[level]
        if y is None:
            self.waits[level] = x
            return
        s, self.waits[level] = self.sums[level], None
        half = s ^ x
        self.sums[level] = half ^ y
        self.add((s & x) | (half & y), level + 1)

    def settle(self) -> None:
        """Take in what waits. A count of at most BITS has no carry beyond these levels."""
        for level in range(BITS.bit_length()):
            if level < len(self.sums) and self.waits[level] is not None:
                self.add(np.zeros_like(self.sums[level]), level)

    def exceeds(self, radius: int) -> np.ndarray:
        """Lanes whose count (of what went through) is over the radius."""
        over, equal = np.zeros_like(self.sums[0]), ~np.zeros_like(self.sums[0])
        if radius >> len(self.sums):
            return over
        for level in range(len(self.sums) - 1, -1, -1):
            s = self.sums[level]
            if radius >> level & 1:
                equal &= s
            else:
                over |= equal & s
                equal &= ~s
        return over


def near_lanes(difference: Callable[[int], np.ndarray], radius: int, every: int = 128) -> np.ndarray | None:
    """The lanes that differ in at most `radius` of BITS planes; None if a block was abandoned because all exceed it."""
    counter = CarrySave()
    for k in range(BITS):
        counter.add(difference(k))
        if k % every == every - 1 and k + 1 < BITS and not (~counter.exceeds(radius)).any():
            return None
    counter.settle()
    return ~counter.exceeds(radius)


def _lanes(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=-1, bitorder="little")


def across(rows: np.ndarray, lanes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): row i and lane j are within the radius; 64 rows at a time are held against all lanes."""
    p, bits, found_i, found_j = planes(lanes), np.unpackbits(rows, axis=1), [], []
    for at in range(0, len(rows), 64):
        mask = (0 - bits[at:at + 64].T.astype(np.int64)).view(np.uint64)
        near = near_lanes(lambda k: p[k][None, :] ^ mask[k][:, None], radius)
        if near is not None:
            i, j = np.nonzero(_lanes(near)[:, : len(lanes)])
            found_i.append(i + at)
            found_j.append(j)
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))


def shifted(p: np.ndarray, d: int) -> np.ndarray:
    """Planes in which lane i holds what lane i + d held."""
    whole, rest = divmod(d, 64)
    out = np.zeros_like(p)
    w = p.shape[1] - whole
    if w > 0:
        out[:, :w] = p[:, whole:] >> np.uint64(rest)
        if rest and w > 1:
            out[:, : w - 1] |= p[:, whole + 1:] << np.uint64(64 - rest)
    return out


def side_by_side(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j, of one group (sorted) and within the radius: lane i meets lane i + d, over all groups of more than d at once."""
    size = np.bincount(group)[group] if len(group) else group
    found_i, found_j, d = [], [], 0
    while len(at := np.flatnonzero(size > (d := d + 1))):
        if d == 1 or len(at) < 0.75 * p.shape[1] * 64:
            lanes = at
            p = planes(prints[lanes])
        q = shifted(p, d)
        near = near_lanes(lambda k: p[k] ^ q[k], radius)
        if near is None or len(lanes) <= d:
            continue
        ok = np.flatnonzero(_lanes(near)[: len(lanes) - d])
        ok = ok[group[lanes[ok]] == group[lanes[ok + d]]]
        found_i.append(lanes[ok])
        found_j.append(lanes[ok + d])
    return (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_i, found_j))


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (least, other) that connect what the pairs (a, b) connect: one for each node but the least of each component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a):]
    top = np.arange(len(nodes))
    while len(i):
        low = np.minimum(top[i], top[j])
        for end in (top[i], top[j]):
            np.minimum.at(top, end, low)
        top = top[top]
        apart = top[i] != top[j]
        i, j = i[apart], j[apart]
    while not np.array_equal(up := top[top], top):
        top = up
    other = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[top[other]], nodes[other]


def block_links(strays: list[tuple], lanes: list[tuple], shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links (a, b) that join the groups which any pair of a stray and a lane of the similarity joins, at most one less than groups.

    Both have (node, group, text). Every stray's common shingles with all lanes are counted at once, from the lanes of each shingle.
    """
    ids: dict[bytes, int] = {}
    held, who, size = array("q"), array("q"), []
    for j, (_, _, text) in enumerate(lanes):
        s = shingles(text, shingle)
        held.extend(ids.setdefault(x, len(ids)) for x in s)
        who.extend(itertools.repeat(j, len(s)))
        size.append(len(s))
    held, who, size = np.array(held, np.int64), np.array(who, np.int64), np.array(size, np.int64)
    order = np.argsort(held, kind="stable")
    who, first = who[order], np.searchsorted(held[order], np.arange(len(ids) + 1)).tolist()
    node, group = (np.array([x[i] for x in lanes], np.int64) for i in (0, 1))
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while x in above:
            x = above[x]
        return x

    links = []
    for a, mine, text in strays:
        s = shingles(text, shingle)
        found = [who[first[k]:first[k + 1]] for x in s if (k := ids.get(x)) is not None]
        if not found:
            continue
        both = np.bincount(np.concatenate(found), minlength=len(lanes))
        near = np.flatnonzero((both / (len(s) + size - both) >= similarity) & (group != mine))
        for other, at in zip(*(x.tolist() for x in np.unique(group[near], return_index=True))):
            x, y = top(mine), top(other)
            if x != y:
                above[max(x, y)] = min(x, y)
                b = int(node[near[at]])
                links.append((min(a, b), max(a, b)))
    return links


def _prints(docs: DataFrame, key: str, text: str, shingle: int) -> tuple[DataFrame, list[str]]:
    """The rows numbered, each with copy (equal word sequences have one), and the print and bands of a text with words."""
    rows, names = numbered(docs)
    where = names.index(text)
    out = T.StructType([*rows.schema.fields, T.StructField("copy", T.BinaryType()), T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, whole.num_columns - 1):
                texts = [_lower(x) for x in batch.column(batch.num_columns - 1).to_pylist()]
                h, bounds = shingle_hashes(texts, shingle)
                full = np.flatnonzero(np.diff(bounds))
                prints: list = [None] * len(texts)
                bands: list = [None] * len(texts)
                if len(full):
                    for i, p, b in zip(full.tolist(), wide_fingerprints(h, np.r_[bounds[full], len(h)]), minhash_bands(h, bounds[full])):
                        prints[i], bands[i] = p, b
                copy = [xxhash.xxh3_128_digest(b" ".join(x.split()), SEED) for x in texts]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(copy, pa.binary()), pa.array(prints, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], out.names)

    read = rows.withColumn("text", F.col(f"c{where}").cast("string"))
    return materialize(read.mapInArrow(run, out), "prints").withColumns({"key": F.col(f"c{names.index(key)}"), "text": F.col(f"c{where}").cast("string")}), names


def _alike(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have the similarity."""

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, s = None, set()
        for whole in batches:
            for batch in slices(whole, 2):
                ok = []
                for a, x, y in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                    if a != last:
                        last, s = a, shingles(x, shingle)
                    t = shingles(y, shingle)
                    both = len(s & t)
                    ok.append(both / (len(s) + len(t) - both) >= similarity)
                yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    asked = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    held = materialize(texts.join(asked, "row", "left_semi"), "texts")
    for end in ("a", "b"):
        pairs = pairs.join(held.select(F.col("row").alias(end), F.col("text").alias(f"text_{end}")), end)
    return materialize(pairs.select("a", "b", "text_a", "text_b").mapInArrow(same, "a long, b long"), "alike")


def _close(pairs: DataFrame, nodes: DataFrame, radius: int) -> DataFrame:
    """The pairs (a, b) whose prints are within the radius."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("print").alias(f"print_{end}")), end)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p, q = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array(np.bitwise_count(p ^ q).sum(axis=1) <= radius))

    return materialize(pairs.select("a", "b", "print_a", "print_b").mapInArrow(near, "a long, b long"), "close")


def _pairs(node_and_others: DataFrame) -> DataFrame:
    """Rows (node, x, y) as distinct pairs a < b of the node and each of the others."""
    pairs = node_and_others.select("node", F.explode(F.array("x", "y")).alias("other")).where("other is not null and node <> other")
    return materialize(pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "pairs")


def _first_pairs(buckets: DataFrame) -> DataFrame:
    """Every member with the smallest node that it shares a bucket with, and with that of its largest bucket: two pairs a node, however large its buckets are."""
    ends = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1"), "ends")
    return _pairs(buckets.join(ends, "bucket").groupBy("node").agg(F.min("first").alias("x"), F.max_by("first", F.struct("n", "bucket")).alias("y")))


def _next_pairs(buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Members outside their bucket's commonest group with two members of such groups: two pairs a node again, of those alone."""
    held = materialize(buckets.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")), "held")
    kinds = held.groupBy("bucket", "component").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("h"), "node"))["node"].alias("one"))
    common = kinds.groupBy("bucket").agg(F.max(F.struct("n", "component", "one")).alias("most"), F.count("*").alias("kinds")).where("kinds > 1")
    common = materialize(common.select("bucket", F.col("most.component").alias("common"), F.col("most.n").alias("n"), F.col("most.one").alias("one")), "common")
    strays = held.join(common, "bucket").where("component <> common")
    return _pairs(strays.groupBy("node").agg(F.max_by("one", F.struct("n", "bucket")).alias("x"), F.min_by("one", F.struct("n", "bucket")).alias("y")))


def _other_pairs(buckets: DataFrame, nodes: DataFrame, groups: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect what the pairs of a bucket connect that lie in different groups so far and are within the radius.

    Members outside a bucket's commonest group are held against all its members. Both sides
    are dealt into blocks, so no task holds more than 2 * BLOCK members, however large a bucket is. Of the pairs
    that it finds a task keeps what connects them, a link a member at most.
    """
    spark = buckets.sparkSession
    held = buckets.join(groups, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    held = materialize(held, "held")
    size = held.groupBy("bucket", "component").count().groupBy("bucket").agg(F.sum("count").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("count", "component")).alias("most")).where("kinds > 1")
    size = size.select("bucket", F.col("most.component").alias("common"), F.ceil(F.col("n") / BLOCK).cast("int").alias("n_lanes"), F.ceil((F.col("n") - F.col("most.count")) / BLOCK).cast("int").alias("n_rows"))
    mixed = materialize(held.join(materialize(size, "sizes"), "bucket"), "mixed")
    if mixed.isEmpty():
        return spark.createDataFrame([], "a long, b long")
    mixed = mixed.join(nodes.select("node", "print"), "node")
    h = F.xxhash64("node")

    def block(of, n):
        return F.pmod(h, F.col(n)).cast("int").alias(of)

    def every(of, n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(of)

    member = ["bucket", "node", "component", "print"]
    lanes = mixed.select(*member, "n_lanes", block("lane_block", "n_lanes"), every("row_block", "n_rows"), F.lit(False).alias("stray"))
    strays = mixed.where("component <> common").select(*member, "n_lanes", every("lane_block", "n_lanes"), block("row_block", "n_rows"), F.lit(True).alias("stray"))
    dealt = lanes.unionByName(strays).select("bucket", "row_block", "lane_block", "stray", "node", "component", "print", (F.col("n_lanes") == 1).alias("whole"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(t: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([t.column(i).to_numpy().astype(np.int64) for i in range(3)], axis=1)
            new = np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]
            starts = np.flatnonzero(new)
            sizes = np.diff(np.r_[starts, len(keys)])
            stray, node, component = t.column(3).to_numpy(), t.column(4).to_numpy(), t.column(5).to_numpy()
            prints = np.frombuffer(b"".join(t.column(6).to_pylist()), np.uint8).reshape(-1, BITS // 8)
            links = np.zeros((2, 0), np.int64)

            def take(i: np.ndarray, j: np.ndarray) -> np.ndarray:
                apart = component[i] != component[j]
                return np.stack(stars(*(np.r_[old, node[x[apart]]] for old, x in zip(links, (i, j)))))

            little = (sizes <= SMALL) & t.column(7).to_numpy()[starts]  # and all its members are lanes here
            small = np.repeat(little, sizes)
            if small.any():
                at = np.flatnonzero(small & ~stray)
                i, j = side_by_side(np.cumsum(new)[at], prints[at], radius)
                links = take(at[i], at[j])
            for s, n, done_already in zip(starts.tolist(), sizes.tolist(), little.tolist()):
                if not done_already:
                    mine = np.arange(s, s + n)
                    rows, lanes = mine[stray[mine]], mine[~stray[mine]]
                    for strip in (rows[x:x + STRIP] for x in range(0, len(rows), STRIP)):
                        i, j = across(prints[strip], prints[lanes], radius)
                        links = take(strip[i], lanes[j])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in links], ["a", "b"])

        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            if held.num_rows < 2 * BLOCK:
                continue
            last = [held.column(i)[-1].as_py() for i in range(3)]
            same = np.logical_and.reduce([held.column(i).to_numpy() == x for i, x in enumerate(last)])
            cut = held.num_rows - int(same.sum())  # rows are sorted, so the last block's are at the end
            if cut:
                yield from done(held.slice(0, cut).combine_chunks())
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from done(held.combine_chunks())

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["bucket", "row_block", "lane_block"]
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long")


def _rest_links(near: DataFrame, groups: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of the similarity that join the groups of what the links `near` connect, whatever their prints: shingle sets decide.

    In each component of `near` members outside its commonest group are held against all, both sides in blocks by number and
    size of text. A text comes to its blocks once, not once a pair, and a block gives fewer links than it has members.
    """
    held = connected_components(near).select("node", F.col("component").alias("near")).join(groups, "node", "left").select("near", "node", F.coalesce("component", "node").alias("component"))
    held = materialize(held.join(texts.select(F.col("row").alias("node"), "text"), "node"), "texts")
    size = held.groupBy("near", "component").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    size = size.groupBy("near").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "component", "bytes")).alias("most"))

    def blocks(n, size):
        return F.greatest(F.ceil(n / TEXTS), F.ceil(size / TEXT_BYTES), F.lit(1)).cast("int")

    most = F.col("most")
    size = size.select("near", most["component"].alias("common"), blocks(F.col("n"), F.col("bytes")).alias("n_lanes"), blocks(F.col("n") - most["n"], F.col("bytes") - most["bytes"]).alias("n_rows"))
    held, h = held.join(materialize(size, "sizes"), "near"), F.xxhash64("node")
    member = ["node", "component", "text"]

    def block(of, n):
        return F.pmod(h, F.col(n)).cast("int").alias(of)

    def every(of, n):
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(of)

    lanes = held.select("near", every("row_block", "n_rows"), block("lane_block", "n_lanes"), F.lit(False).alias("stray"), *member)
    strays = held.where("component <> common").select("near", block("row_block", "n_rows"), every("lane_block", "n_lanes"), F.lit(True).alias("stray"), *member)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = (x for batch in batches for x in zip(*(c.to_pylist() for c in batch.columns)))
        for _, block in itertools.groupby(members, key=lambda x: x[:3]):
            sides: tuple[list, list] = ([], [])
            for x in block:
                sides[x[3]].append(x[4:])
            if links := block_links(sides[True], sides[False], shingle, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links)], ["a", "b"])

    n = int(near.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["near", "row_block", "lane_block"]
    return materialize(lanes.unionByName(strays).repartition(n, *keys).sortWithinPartitions(*keys).mapInArrow(compare, "a long, b long"), "links")


def _merged(groups: DataFrame, more: DataFrame) -> DataFrame:
    """The groups (node, component) that further links (a, b) make: components of components, over those links alone."""
    for end in ("a", "b"):
        of = groups.select(F.col("node").alias(end), F.col("component").alias("top"))
        more = more.join(of, end, "left").withColumn(end, F.coalesce("top", end)).drop("top")
    tops = materialize(connected_components(more.select("a", "b")), "tops")
    old = groups.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = tops.join(groups.select("node"), "node", "left_anti").select("node", "component")
    return materialize(old.unionByName(new), "groups")


def _labelled(docs: DataFrame, key: str, text: str, shingle: int, similarity: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """The numbered rows, (copy, component, first row by key, smallest key) of every copy, and the old names."""
    if similarity < 0.8:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    radius = radius_for(similarity)
    rows, names = _prints(docs, key, text, shingle)
    order = F.struct(F.col("key").isNull().alias("unknown"), F.col("key").alias("key"), F.col("row").alias("row"))
    nodes = rows.groupBy("copy").agg(F.min(order).alias("least"), F.min("row").alias("node"), F.first("print").alias("print"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")
    buckets = nodes.where("bands is not null").select("node", F.explode("bands").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    buckets = materialize(buckets.join(materialize(shared, "shared"), "bucket"), "buckets")
    texts = rows.select("row", "text")
    links = _alike(_close(_first_pairs(buckets), nodes, radius), texts, shingle, similarity)
    groups = materialize(connected_components(links), "groups")
    for _ in range(ROUNDS):
        more = _next_pairs(buckets, groups)
        if more.isEmpty():
            break
        more = _alike(_close(more, nodes, radius), texts, shingle, similarity)
        if more.isEmpty():
            break
        groups = _merged(groups, more)
    rest = materialize(_other_pairs(buckets, nodes, groups, radius).distinct(), "rest")
    if not rest.isEmpty():
        more = _rest_links(rest, groups, texts, shingle, similarity)
        if not more.isEmpty():
            groups = _merged(groups, more)
    of = nodes.join(groups, "node", "left").select("copy", "least", F.coalesce("component", "node").alias("component"))
    return rows, materialize(of, "labelled"), names


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Every row and its group: (key, component_id), the smallest key reachable over pairs of at least the Jaccard similarity.

    Equal word sequences are one node. Nodes that agree in a band of MinHash values meet in
    a bucket. First each is held against two nodes of its buckets, so a large group of near
    copies takes links in proportion to its size; then, ROUNDS times, those outside their bucket's
    commonest group against two of such groups; then, in buckets that still hold several
    groups, all pairs of different groups are compared, bit-sliced, and what the close ones connect is
    held against each other by shingle sets, in blocks. No pair that met goes
    unexamined unless it is linked already, and no link rests on an estimate: shingle sets decide.

    Null and empty texts are copies of each other. Rows that repeat a key are rows of their own;
    rows with a null key are in their copies' group, whose id is null only if all its keys are.
    An empty table gives an empty result. Other columns are left out, whatever their names.
    """
    rows, of, _ = _labelled(docs, key, text, shingle, similarity)
    ids = of.groupBy("component").agg(F.min("least")["key"].alias("component_id"))
    ids = materialize(of.select("copy", "component").join(materialize(ids, "ids"), "component").select("copy", "component_id"), "copies")
    return rows.select("key", "copy").join(ids, "copy").select(F.col("key").alias(key), "component_id")


def near_copy_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies: the one with the smallest key, of equal keys the first.

    Rows with a null key come after all others of their group. Nothing else goes: rows that
    share a key but no group all stay. An empty table gives an empty result.
    """
    rows, of, names = _labelled(docs, key, text, shingle, similarity)
    firsts = of.groupBy("component").agg(F.min("least")["row"].alias("kept"))
    gone = of.select("copy", "component").join(materialize(firsts, "firsts"), "component").select("copy", "kept")
    gone = rows.select("row", "copy").join(materialize(gone, "copies"), "copy").where("row <> kept")
    return without(rows, materialize(gone.select("row"), "gone"), names)
