"""Sampled segmentations by Gumbel top-k: encoding and decoding with a SentencePiece vocabulary.

A text's lattice is that of its words one after the other (no piece crosses a word's
start), and a segmentation's probability is the product of its pieces' weights over the
sum of all segmentations' products. The k segmentations with the largest Gumbel-perturbed
log-probabilities are a sample without replacement. They are found best first: a state is
a path into the lattice with the perturbed maximum of all its completions. The state with
the largest maximum is completed edge by edge, each edge drawn by its share of the mass,
which leaves the maximum as it is; the edges not drawn stay behind as one state per edge
whose maximum is a Gumbel variable truncated at it. So a sample costs one walk over the
text. All texts of a batch walk in step, each with random numbers of its own that are a
function of its key and of where in the walk they are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Characters of the texts that are worked on at once.
BATCH_CHARS = 500_000
#: Piece ids that are decoded at once.
BATCH_IDS = 1_000_000
#: Longest run of characters taken as one word of the lattice; a longer one is cut there.
MAX_WORD = 64
#: Weight of a piece of rank r is (r + RANK_SHIFT) ** -1, so frequent pieces weigh more.
RANK_SHIFT = 100.0
#: Log shares are summed as whole multiples of 1 / STEPS, so sums do not depend on their order.
STEPS = 2.0**36


class Vocabulary:
    """Pieces, their log weights by rank, a trie of them, and the byte pieces that spell what no piece does."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.piece = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        rank = {i: r for r, i in enumerate(plain)}
        self.ids = {self.piece[i]: (i, -math.log(rank[i] + RANK_SHIFT)) for i in plain}
        self.byte = {int(self.piece[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.byte_weight = -math.log(n + RANK_SHIFT)
        self.longest = max(len(p) for p in self.ids)
        spelled = [p.encode() for p in self.piece]
        for b, i in self.byte.items():
            spelled[i] = bytes([b])
        self.spelled = pa.array(spelled, pa.binary())
        self.weight = np.zeros(n)
        for i, w in self.ids.values():
            self.weight[i] = w
        self._build_trie()

    def _build_trie(self) -> None:
        chars = sorted({c for p in self.ids for c in p})
        self.cls = np.zeros(0x110000, np.int64)
        self.cls[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        kind = {c: i + 1 for i, c in enumerate(chars)}
        self.width = len(chars) + 1
        edges: dict[int, int] = {}
        names = [-1]
        for p, (i, _) in self.ids.items():
            state = 0
            for c in p:
                key = state * self.width + kind[c]
                if key not in edges:
                    edges[key] = len(names)
                    names.append(-1)
                state = edges[key]
            names[state] = i
        self.name = np.array(names, np.int64)
        bits = (4 * len(edges)).bit_length()
        self.shift = np.uint64(64 - bits)
        self.keys, self.next = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int64)
        keys = np.fromiter(edges, np.int64, len(edges))
        for key, slot, state in zip(keys.tolist(), self._slot(keys).tolist(), edges.values()):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.next[slot] = key, state

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The trie's state after a character of each kind, -1 where no piece goes on."""
        keys = state * self.width + kind
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.next[slot], -1)
        more = np.flatnonzero((held != keys) & (held >= 0))
        while len(more):
            slot[more] = (slot[more] + 1) % len(self.keys)
            held = self.keys[slot[more]]
            hit = held == keys[more]
            out[more[hit]] = self.next[slot[more[hit]]]
            more = more[~hit & (held >= 0)]
        return out


_known: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _known:
        _known[path] = Vocabulary(path)
    return _known[path]


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(length)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Random numbers between 0 and 1, both excluded: a mixing function of each row's seed and a counter."""
    z = seed + counter.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


class Lattice:
    """The lattices of distinct words as flat arrays; a word is cut every MAX_WORD characters into parts.

    A node is a character of a part. Nodes are in the order of their distance from the part's
    end, edges in the order of their nodes and, for one node, of their lengths.
    A character without a piece has an edge spelled by its bytes; its id is the negative of
    its code point less one.
    """

    def __init__(self, words: list[str], vocab: Vocabulary) -> None:
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        chars = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(chars)
        self.n_parts = -(-lengths // MAX_WORD)
        self.first_part = np.cumsum(self.n_parts) - self.n_parts
        size = np.full(int(self.n_parts.sum()), MAX_WORD, np.int64)
        size[self.first_part + self.n_parts - 1] = lengths - (self.n_parts - 1) * MAX_WORD
        ends = np.cumsum(size)
        left = np.repeat(ends, size) - np.arange(n)
        pos = np.argsort(left.astype(np.uint8), kind="stable")
        node = np.full(n + 1, -1, np.int64)
        node[pos] = np.arange(n)
        self.start = node[ends - size]
        self._edges(chars, pos, left[pos], node, vocab)
        self._weigh(np.r_[0, np.cumsum(np.bincount(left, minlength=1))[1:]] if n else np.zeros(1, np.int64))

    def _edges(self, chars: np.ndarray, pos: np.ndarray, left: np.ndarray, node: np.ndarray, vocab: Vocabulary) -> None:
        n, kind = len(pos), vocab.cls[chars]
        single = -chars[pos] - 1
        code = chars[pos]
        spell = (1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)) * vocab.byte_weight
        at, state, found = np.arange(n), np.zeros(n, np.int64), []
        for d in range(vocab.longest):
            live = left[at] > d
            at, state = at[live], state[live]
            state = vocab.step(state, kind[pos[at] + d])
            go = state >= 0
            at, state = at[go], state[go]
            name = vocab.name[state]
            full = name >= 0
            if d:
                found.append((at[full], name[full]))
            else:
                single[at[full]] = name[full]
                found.append((np.arange(n), single))
            if not len(at):
                break
        degree = np.zeros(n, np.int64)
        for where, _ in found:
            degree[where] += 1
        self.first = np.r_[0, np.cumsum(degree)]
        self.degree = degree
        total = int(self.first[-1])
        self.ids, self.ends, self.weights = np.empty(total, np.int32), np.empty(total, np.int64), np.empty(total)
        free = self.first[:-1].copy()
        for d, (where, name) in enumerate(found):
            e = free[where]
            self.ids[e] = name
            self.ends[e] = np.where(left[where] == d + 1, -1, node[pos[where] + d + 1])
            self.weights[e] = vocab.weight[np.maximum(name, 0)] if d else np.where(name >= 0, vocab.weight[np.maximum(name, 0)], spell)
            free[where] += 1

    def _weigh(self, levels: np.ndarray) -> None:
        """Masses from the ends backwards, then each edge's share of its node's mass."""
        first, mass = self.first, np.zeros(len(self.first))  # the last entry, the mass beyond an end, stays 0
        for a, b in zip(levels[:-1], levels[1:]):
            if a == b:
                continue
            lo, hi = first[a], first[b]
            w = self.weights[lo:hi] + mass[self.ends[lo:hi]]
            top = np.maximum.reduceat(w, first[a:b] - lo)
            mass[a:b] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, self.degree[a:b])), first[a:b] - lo))
        log = self.weights + mass[self.ends] - np.repeat(mass[:-1], self.degree)
        del self.weights
        self.share = np.exp(log)
        alone = np.repeat(self.degree == 1, self.degree)
        self.share[alone], log[alone] = 1.0, 0.0
        self.log = np.rint(log * STEPS).astype(np.int64)
        self.others = np.log1p(-self.share, where=self.share < 1 - 1e-12, out=np.full(len(log), -np.inf))
        self.cdf = self.share.copy()
        for s in range(1, int(self.degree.max(initial=0))):
            e = first[:-1][self.degree > s] + s
            self.cdf[e] += self.cdf[e - 1]
        self.cdf[first[1:] - 1] = 1.0

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge that u falls on at each node."""
        e = self.first[node]
        more = np.flatnonzero(u >= self.cdf[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.cdf[e[more]]]
        return e

    def walk(self, cur: np.ndarray, seed: np.ndarray, counter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from each node to its part's end, one walk after the other, and how many each walk has."""
        at, count, steps = np.arange(len(cur)), np.zeros(len(cur), np.int64), []
        while len(at):
            e = self.draw(cur, uniform(seed[at], counter[at] + len(steps)))
            steps.append((at, e))
            count[at] += 1
            cur = self.ends[e]
            go = cur >= 0
            at, cur = at[go], cur[go]
        off, out = np.cumsum(count) - count, np.empty(int(count.sum()), np.int64)
        for s, (at, e) in enumerate(steps):
            out[off[at] + s] = e
        return out, count


@dataclass
class Paths:
    """One sample of each text in `rows`, and the states that it left behind."""

    rows: np.ndarray
    top: np.ndarray  # perturbed log probability
    edges: np.ndarray
    word: np.ndarray  # each edge's part, counted within the text
    first: np.ndarray  # each row's first edge, and the end
    fixed: np.ndarray  # edges taken over from the path it branched from, the branch's own included
    gone: np.ndarray  # edges that were drawn at the branch, -1 to fill
    log_prob: np.ndarray
    before: np.ndarray  # log mass before each edge
    state: np.ndarray  # the perturbed mass of the edges not drawn there, before truncation

    def maxima(self) -> np.ndarray:
        """Each row's largest state, truncated at the path's own value."""
        return -np.logaddexp(-self.top, -np.maximum.reduceat(self.state, self.first[:-1]))

    def argmax(self) -> np.ndarray:
        """Where each row's largest state lies."""
        length = np.diff(self.first)
        hit = np.flatnonzero(self.state == np.repeat(np.maximum.reduceat(self.state, self.first[:-1]), length))[::-1]
        out = np.empty(len(length), np.int64)
        out[np.repeat(np.arange(len(length)), length)[hit]] = hit
        return out


class Sampler:
    """The walks of a batch of texts (no nulls), each with the seed of its row."""

    def __init__(self, texts: pa.Array, seeds: np.ndarray, vocab: Vocabulary) -> None:
        cut = pc.split_pattern(pc.replace_substring(texts, SPACE, " "), " ")
        coded = cut.flatten().dictionary_encode()
        self.lattice = lat = Lattice(coded.dictionary.to_pylist(), vocab)
        words = coded.indices.to_numpy().astype(np.int64)
        n = lat.n_parts[words]
        bounds = np.r_[0, np.cumsum(pc.list_value_length(cut).to_numpy())]
        self.parts = lat.start[ranges(lat.first_part[words], n)]
        self.first = np.r_[0, np.cumsum(n)][bounds]
        self.seeds = seeds

    def _path(self, r: int, rows, top, edges, word, first, fixed, gone, rest) -> Paths:
        lat, length = self.lattice, np.diff(first)
        log = lat.log[edges]
        total = np.cumsum(log)
        base = (total - log)[first[:-1]]
        before = (total - log - np.repeat(base, length)) / STEPS
        place = ranges(np.zeros(len(rows), np.int64), length)
        noise = -np.log(-np.log(uniform(np.repeat(self.seeds[rows], length), place + ((2 * r + 1) << 48))))
        state = before + lat.others[edges] + noise
        state[place < np.repeat(fixed, length)] = -np.inf
        if r:  # the branch itself: what neither earlier samples nor this one drew
            at = first[:-1] + fixed - 1
            state[at] = before[at] + np.log(rest, where=rest > 1e-12, out=np.full(len(rest), -np.inf)) + noise[at]
        return Paths(rows, top, edges, word, first, fixed, gone, (total[first[1:] - 1] - base) / STEPS, before, state)

    def _first(self) -> Paths:
        rows, length = np.arange(len(self.seeds)), np.diff(self.first)
        word = ranges(np.zeros(len(rows), np.int64), length)
        edges, count = self.lattice.walk(self.parts, np.repeat(self.seeds, length), word << 7)
        first = np.r_[0, np.cumsum(count)][self.first]
        top = -np.log(-np.log(uniform(self.seeds, np.full(len(rows), 1 << 62))))
        return self._path(0, rows, top, edges, np.repeat(word, count), first, np.zeros(len(rows), np.int64), np.full((len(rows), 1), -1), None)

    def _branch(self, r: int, held: list[Paths], rows: np.ndarray, which: np.ndarray, top: np.ndarray) -> Paths:
        """The samples that complete each row's largest state, which lies on path which[row]."""
        lat, m = self.lattice, len(rows)
        i, begin, old, word, node_gone = (np.empty(m, np.int64) for _ in range(5))
        gone = np.full((m, r + 1), -1)
        prefixes = []
        for p, path in enumerate(held):
            mine = np.flatnonzero(which == p)
            slot = np.searchsorted(path.rows, rows[mine])
            at = path.argmax()[slot]
            i[mine], begin[mine] = at - path.first[slot], path.first[slot]
            old[mine], word[mine] = path.edges[at], path.word[at]
            again = i[mine] == path.fixed[slot] - 1
            gone[mine[again], :path.gone.shape[1]] = path.gone[slot[again]]
            gone[mine[~again], 0] = path.edges[at[~again]]
            path.state[at] = -np.inf
            prefixes.append((mine, path))
        node = np.searchsorted(lat.first, old, side="right") - 1
        option = lat.first[node][:, None] + np.arange(int(lat.degree[node].max()))
        share = np.where(option < lat.first[node + 1][:, None], lat.share[np.minimum(option, len(lat.share) - 1)], 0.0)
        for c in range(r):
            share[option == gone[:, c:c + 1]] = 0.0
        total = np.cumsum(share, axis=1)
        u = uniform(self.seeds[rows], np.full(m, (1 << 61) + r))
        last = share.shape[1] - 1 - np.argmax(share[:, ::-1] > 0, axis=1)
        pick = np.minimum((total <= (u * total[:, -1])[:, None]).sum(axis=1), last)
        edge = option[np.arange(m), pick]
        share[np.arange(m), pick] = 0.0
        gone[:, r] = edge

        inside = lat.ends[edge] >= 0
        count = inside + (self.first[rows + 1] - self.first[rows] - 1 - word)
        off = np.r_[0, np.cumsum(count)]
        part = ranges(word + 1 - inside, count)
        cur = self.parts[np.repeat(self.first[rows], count) + part]
        cur[off[:-1][inside]] = lat.ends[edge[inside]]
        tail, steps = lat.walk(cur, np.repeat(self.seeds[rows], count), (part << 7) + ((2 * r) << 48))
        n_tail = np.diff(np.r_[0, np.cumsum(steps)][off])
        first = np.r_[0, np.cumsum(i + 1 + n_tail)]
        edges, words = np.empty(int(first[-1]), np.int64), np.empty(int(first[-1]), np.int64)
        for mine, path in prefixes:
            to, source = ranges(first[mine], i[mine]), ranges(begin[mine], i[mine])
            edges[to], words[to] = path.edges[source], path.word[source]
        edges[first[:-1] + i], words[first[:-1] + i] = edge, word
        to = ranges(first[:-1] + i + 1, n_tail)
        edges[to], words[to] = tail, np.repeat(part, steps)
        return self._path(r, rows, top, edges, words, first, i + 1, gone, share.sum(axis=1))

    def samples(self, k: int) -> tuple[list[Paths], np.ndarray]:
        """Up to k samples of every text, largest first, and the value that the next one would have (-inf: there is none)."""
        held = [self._first()]
        while True:
            maxima = np.full((len(held), len(self.seeds)), -np.inf)
            for p, path in enumerate(held):
                maxima[p, path.rows] = path.maxima()
            best = maxima.max(axis=0)
            rows = np.flatnonzero(best > -np.inf)
            if len(held) == k or not len(rows):
                return held, best
            held.append(self._branch(len(held), held, rows, maxima.argmax(axis=0)[rows], best[rows]))


def spelled_ids(names: np.ndarray, first: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids and bounds of the rows; characters without a piece are spelled by their bytes."""
    odd = np.flatnonzero(names < 0)
    if not len(odd):
        return names, first
    kinds, which = np.unique(names[odd], return_inverse=True)
    spell = [[vocab.byte[c] for c in chr(-x - 1).encode("utf-8", "surrogatepass")] for x in kinds.tolist()]
    sizes = np.array([len(s) for s in spell])
    width = np.ones(len(names), np.int64)
    width[odd] = sizes[which]
    bounds = np.r_[0, np.cumsum(width)]
    out = np.repeat(names, width)
    out[ranges(bounds[odd], width[odd])] = np.concatenate(spell)[ranges((np.cumsum(sizes) - sizes)[which], width[odd])]
    return out, bounds[first]


def sample_segmentations(docs: DataFrame, model_path: str, k: int = 2, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """Up to k distinct segmentations of every text, sampled without replacement.

    Returns (key, rank from 1, ids, n_pieces, log_prob, gumbel, inclusion): gumbel is the
    perturbed log probability, and inclusion the chance of a segmentation to exceed the
    k+1-th largest one, 1 - exp(-exp(log_prob - threshold)), which weighs an unbiased
    estimate (1 where all segmentations are listed). Random numbers come from the key and
    the seed alone, so a row's samples do not depend on where it is processed.

    Texts are worked on whole, BATCH_CHARS characters at a time or one longer text alone, which
    takes about 150 bytes a character. Null and empty texts have the single segmentation of
    the space put in front.
    Repeated rows have equal samples; a null key is seeded as -1. An empty table gives an
    empty result. Other columns are left out.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["key", "rank", "ids", "n_pieces", "log_prob", "gumbel", "inclusion"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)

        def work(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            seeds = np.array([xxhash.xxh64_intdigest(str(-1 if x is None else x), seed) for x in b.column(0).to_pylist()], np.uint64)
            sampler = Sampler(b.column(1), seeds, vocab)
            found, limit = sampler.samples(k)
            for rank, p in enumerate(found):
                ids, first = spelled_ids(sampler.lattice.ids[p.edges], p.first, vocab)
                n = np.diff(first)
                chance = -np.expm1(-np.exp(np.minimum(700.0, p.log_prob - limit[p.rows])))
                lists = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(p.rows)), pa.array(np.full(len(n), rank + 1), pa.int32()), lists, pa.array(n, pa.int64()), pa.array(p.log_prob), pa.array(p.top), pa.array(chance)], names)

        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(0), pc.fill_null(b.column(1), "")], ["key", "text"])
            ends = np.cumsum(pc.utf8_length(b.column(1)).to_numpy().astype(np.int64) + 1)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_CHARS, side="right")))
                yield from work(b.slice(at, to - at))
                at = to

    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = source.mapInArrow(run, f"key {kind}, rank int, ids array<int>, n_pieces long, log_prob double, gumbel double, inclusion double")
    return found.withColumnRenamed("key", key)


def decoded(ids: pa.Array, vocab: Vocabulary) -> pa.Array:
    """The texts of lists of ids: byte pieces join into characters, spaces come back, the one put in front goes."""
    length = pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    pieces = vocab.spelled.take(ids.flatten())
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], pa.int32()), pieces), b"")
    try:
        texts = joined.cast(pa.string())
    except pa.ArrowInvalid:  # bytes that spell no character
        texts = pa.array([None if x is None else x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
    texts = pc.utf8_slice_codeunits(pc.replace_substring(texts, SPACE, " "), 1)
    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def decode_segmentations(found: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """found with a column decoded: the text that the ids of each row spell (null for null ids)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(model_path)
        for b in batches:
            where = b.schema.get_field_index(ids)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(b.column(where)), 0).to_numpy().astype(np.int64) + 1)
            at = 0
            while at < b.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_IDS, side="right")))
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column(where), vocab)], [*part.schema.names, "decoded"])
                at = to

    return found.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in found.dtypes) + ", decoded string")
