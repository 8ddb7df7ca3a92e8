"""SimHash fingerprints and their near-duplicate groups by bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize
from quarry.llm.components import connected_components

SEED = 42
BITS = 64
#: Fingerprints are cut into blocks; two within the radius agree on all but `radius` blocks.
BLOCKS = 4
#: A bucket of more fingerprints than this is dealt out again by further bits.
BUCKET = 512
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingles' XXH64 values."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and ASCII white space, only
    if not found:
        return 0
    joined = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(found))
    digest = xxhash.xxh64_intdigest
    n = len(found) - k + 1
    counts = np.zeros(BITS, np.int64)
    a, b = starts[:n].tolist(), ends[k - 1:].tolist()
    for i in range(0, n, CHUNK):
        h = np.array([digest(joined[x:y], SEED) for x, y in zip(a[i:i + CHUNK], b[i:i + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): a row's 64-bit fingerprint as a signed long; a text without words has 0."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py(), shingle) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"key {kind}, fp long")


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of x stored vertically: row p has bit p of every value, 64 values a word."""
    lanes = -(-len(x) // 64) * 64
    wide = np.zeros(lanes, np.uint64)
    wide[: len(x)] = x
    flat = np.unpackbits(wide.view(np.uint8).reshape(lanes, 8), axis=1, bitorder="little")[:, :bits]
    return np.packbits(np.ascontiguousarray(flat.T), axis=1, bitorder="little").view(np.uint64)


def _shifted(p: np.ndarray, d: int) -> np.ndarray:
    """Planes in which lane i holds what lane i + d held."""
    words, rest = divmod(d, 64)
    out = np.zeros_like(p)
    w = p.shape[1] - words
    if w > 0:
        out[:, :w] = p[:, words:] >> np.uint64(rest)
        if rest and w > 1:
            out[:, : w - 1] |= p[:, words + 1:] << np.uint64(64 - rest)
    return out


def within(p: np.ndarray, d: int, radius: int, block: int = 512) -> np.ndarray:
    """Per lane i: whether values i and i + d differ in at most `radius` bits (2 at most).

    Differences of 64 lanes a word are added plane by plane into carry-save counters
    (ones, twos, more); a block of words is abandoned once every lane exceeds the radius.
    """
    out = np.zeros(p.shape[1], np.uint64)
    q = _shifted(p, d)
    for at in range(0, p.shape[1], block):
        a, b = p[:, at:at + block], q[:, at:at + block]
        ones, twos, more = (np.zeros(a.shape[1], np.uint64) for _ in range(3))
        for k in range(p.shape[0]):
            diff = a[k] ^ b[k]
            carry = ones & diff
            ones ^= diff
            more |= twos & carry
            twos ^= carry
            if k % 8 == 7:
                far = more | (ones & twos) if radius == 2 else more | twos if radius == 1 else more | twos | ones
                if not (~far).any():
                    break
        far = more | (ones & twos) if radius == 2 else more | twos if radius == 1 else more | twos | ones
        out[at:at + block] = ~far
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def bucket_links(keys: np.ndarray, values: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that hold each bucket's groups together: positions (member, root), one per member.

    keys are sorted; values of a bucket differ in their low `bits` only. Lane i is
    compared with lane i + d for d = 1, 2, ..., over all buckets larger than d at once.
    """
    n = len(keys)
    label = np.arange(n)
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if n else np.array([], np.int64)
    size = np.repeat(np.diff(np.r_[new, n]), np.diff(np.r_[new, n]))
    lanes, d, p = np.arange(0), 0, None
    while True:
        d += 1
        if p is None or np.count_nonzero(size[lanes] > d) * 2 < len(lanes):
            lanes = np.flatnonzero(size > d)
            if not len(lanes):
                break
            p = planes(values[lanes], bits)
        elif not (size[lanes] > d).any():
            break
        ok = within(p, d, radius)[: len(lanes) - d] if len(lanes) > d else np.zeros(0, bool)
        i = np.flatnonzero(ok & (keys[lanes[: len(ok)]] == keys[lanes[d: d + len(ok)]]))
        a, b = lanes[i], lanes[i + d]
        for _ in range(n):
            a, b = label[a], label[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label = label[label]
    member = np.flatnonzero(label != np.arange(n))
    return member, label[member]


def _cut(rem: np.ndarray, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """The three parts of rem's bits: index, the part, what is left of rem, and how many bits that is."""
    low = 0
    for i in range(3):
        w = (bits - low) // (3 - i)
        mask = np.uint64((1 << w) - 1)
        yield i, (rem >> np.uint64(low)) & mask, (rem & np.uint64((1 << low) - 1)) | ((rem >> np.uint64(low + w)) << np.uint64(low)), bits - w
        low += w


_AGAIN = "a long, b long, key long, node long, rem long, bits int"
#: Levels of dealing out: at the last a bucket holds 2**15 different values at most, so it is always compared.
_LEVELS = 3


def _compare(keyed: DataFrame, level: int, radius: int) -> DataFrame:
    """Links of each bucket of keyed (key, node, rem, bits); a bucket of over BUCKET rows comes back with longer keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = pa.nulls

        def links(k, node, rem, bits):
            a, b = bucket_links(k, rem, int(bits.max()) if len(bits) else 0, radius)
            m = len(a)
            return pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b]), empty(m, pa.int64()), empty(m, pa.int64()), empty(m, pa.int64()), empty(m, pa.int32())], ["a", "b", "key", "node", "rem", "bits"])

        def again(k, node, rem, bits):
            for w in np.unique(bits):
                s = bits == w
                for i, part, left, nb in _cut(rem[s], int(w)):
                    key = (k[s] << np.int64(13 if level == 1 else 10)) | np.int64(i << (11 if level == 1 else 8)) | part.view(np.int64)
                    m = len(key)
                    yield pa.RecordBatch.from_arrays([empty(m, pa.int64()), empty(m, pa.int64()), pa.array(key), pa.array(node[s]), pa.array(left.view(np.int64)), pa.array(np.full(m, nb, np.int32))], ["a", "b", "key", "node", "rem", "bits"])

        held: list[np.ndarray] = []  # rows of the last key so far
        spilling = None

        def split(cols):
            """What can be done now, and what must wait for more rows of its key."""
            k = cols[0]
            cut = np.searchsorted(k, k[-1])
            return [c[:cut] for c in cols], [c[cut:] for c in cols]

        def done(cols):
            k = cols[0]
            if level < _LEVELS and len(k):
                _, inverse, count = np.unique(k, return_inverse=True, return_counts=True)
                hot = count[inverse] > BUCKET
                if hot.any():
                    yield from again(*[c[hot] for c in cols])
                    cols = [c[~hot] for c in cols]
            if len(cols[0]):
                yield links(*cols)

        for batch in batches:
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64), batch.column(3).to_numpy()]
            if not len(cols[0]):
                continue
            if spilling is not None:
                same = cols[0] == spilling
                if same.any():
                    yield from again(*[c[same] for c in cols])
                    cols = [c[~same] for c in cols]
                if not len(cols[0]):
                    continue
                spilling = None
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            ready, held = split(cols)
            yield from done(ready)
            if level < _LEVELS and len(held[0]) > BUCKET:
                spilling = held[0][0]
                yield from again(*held)
                held = []
        if held:
            yield from done(held)

    n = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, _AGAIN)


def fingerprint_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect the nodes of prints (node, fp distinct) whose fingerprints differ in at most `radius` bits.

    Every pair within the radius shares at least BLOCKS - radius blocks, so a key for
    each choice of so many blocks brings it together; in a bucket, bit-sliced comparison
    finds the groups and returns one link per member, never all pairs. Buckets beyond
    BUCKET rows are dealt out again by thirds of their other bits (a pair within the
    radius agrees on one of three), so no task ever holds more than a bounded bucket.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the radius is 0, 1 or 2")
    width = BITS // BLOCKS
    block = [F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    keys = []
    for t, chosen in enumerate(combinations(range(BLOCKS), BLOCKS - 2)):
        rest = [i for i in range(BLOCKS) if i not in chosen]
        key, rem = F.lit(t).cast("long"), F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, width).bitwiseOR(block[i])
        for i in rest:
            rem = F.shiftleft(rem, width).bitwiseOR(block[i])
        keys.append(F.struct(key.alias("key"), F.col("node"), rem.alias("rem"), F.lit(width * len(rest)).alias("bits")))
    keyed = prints.select(F.inline(F.array(*keys)))
    found = None
    for level in range(1, _LEVELS + 1):
        out = materialize(_compare(keyed, level, radius), "buckets")
        links = out.where("a is not null").select("a", "b")
        found = links if found is None else found.unionAll(links)
        keyed = out.where("key is not null").select("key", "node", "rem", "bits")
        if keyed.isEmpty():
            break
    return found


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """Every row with its fingerprint and group: (doc_id, fp, component_id).

    component_id is the smallest key among rows reachable over links of at most `radius`
    bits. Null and empty texts share fingerprint 0 and are linked like any other;
    repeated rows and copies share a fingerprint, which is compared once; a row with a
    null key has its fingerprint's group, or a null group if no other row has it. An
    empty table gives an empty result. Other columns are left out.
    """
    prints = materialize(fingerprints(docs, key, text, shingle), "prints")
    nodes = prints.groupBy("fp").agg(F.min("key").cast("long").alias("node")).where("node is not null")
    nodes = materialize(nodes, "nodes")
    groups = connected_components(fingerprint_links(nodes, radius))
    labelled = nodes.join(groups, "node", "left").select(F.col("fp").alias("_fp"), F.coalesce("component", "node").alias("component_id"))
    out = prints.join(labelled, prints["fp"] == labelled["_fp"], "left")
    return out.select(F.col("key").alias(key), "fp", "component_id")


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs without all but the first row (smallest key) of each group; rows with a null key stay."""
    first = simhash_groups(docs, key, text, shingle, radius).where(F.col(key) == F.col("component_id")).select(F.col(key).alias("_first")).distinct()
    kept = docs.join(first, docs[key] == first["_first"], "left_semi").dropDuplicates([key])
    return kept.unionByName(docs.where(F.col(key).isNull()))
