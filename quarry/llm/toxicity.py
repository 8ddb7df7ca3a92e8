"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialize

#: Insults, as whole lower-case words.
INSULTS = frozenset("""
    idiot idiots idiotic moron morons moronic stupid dumb loser losers pathetic worthless trash garbage scum clown clowns disgusting
    imbecile fool fools jerk jerks bastard bitch crap asshole shit fuck fucking whore slut retard retarded ugly filth filthy vermin
    idiote imbécile connard connasse salaud salope débile crétin ordure pourriture abruti
    idiotin dumm dummkopf arschloch scheiße scheisse hurensohn wichser abschaum trottel depp widerlich
    imbécil estúpido estúpida idiota basura escoria gilipollas cabrón puta mierda asqueroso payaso
""".split())
#: Second-person words.
SECOND = frozenset("""
    you your yours yourself you're youre u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer
    tú ti contigo usted ustedes vosotros
""".split())
#: Characters that stand for letters, and the letters.
DISGUISE = str.maketrans("013457@$!|+", "oieastasilt")

#: Rows of labelled text that lexicon and trees are fitted on, at most; half of them each.
TRAIN_ROWS = 20_000
#: Learned entries, at most.
MAX_LEARNED = 2_000
NEAR = 5
STEMS = (4, 5, 6)
REMEMBERED = 300_000

FEATURES = (
    "insult_rate", "insults", "learned_rate", "learned", "learned_kinds", "learned_weight", "learned_most",
    "near_second_rate", "second_rate", "capital_rate", "shouted_rate", "exclaim_rate", "punctuation_rate", "symbol_rate",
    "digit_rate", "masked_rate", "masked_insults", "words",
)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bare(word: str) -> str:
    """A word in lower case without the marks around it."""
    return word.lower().strip(".,;:!?\"'()[]{}<>*#$%&|-_")


def stems(word: str) -> Iterator[str]:
    """What a lexicon may hold of a word: itself and its beginnings."""
    yield word
    for n in STEMS:
        if len(word) > n:
            yield word[:n] + "-"


class Reader:
    """Dense features of a text under a learned lexicon (entry -> log odds)."""

    def __init__(self, lexicon: dict[str, float]) -> None:
        self.lexicon = lexicon
        self.seen: dict[str, tuple | None] = {}

    def _judge(self, word: str) -> tuple | None:
        """(insult, second person, learned weight, learned entry, shouted, masked, masked insult); None for a plain word."""
        b = bare(word)
        shouted = len(b) > 2 and word.isupper()
        weight, entry = 0.0, ""
        for s in stems(b):
            if (w := self.lexicon.get(s, 0.0)) > weight:
                weight, entry = w, s
        inner = re.sub(r"[\W_]+", "", b.translate(DISGUISE)) if not b.isalpha() else b
        masked = bool(b) and inner != b and any(c.isalpha() for c in b) and not b.isdigit()
        found = (b in INSULTS, b in SECOND, weight, entry, shouted, masked, masked and inner in INSULTS)
        found = found if any(found) else None
        if len(self.seen) >= REMEMBERED:
            self.seen.clear()
        if len(word) <= 64:
            self.seen[word] = found
        return found

    def features(self, text: str) -> list[float]:
        raw = text.encode("utf-8", "surrogatepass")
        found = raw.decode("utf-8", "replace").split()
        n = max(1, len(found))
        seen, judge = self.seen, self._judge
        marks = [(i, m) for i, w in enumerate(found) if (m := seen[w] if w in seen else judge(w))]
        count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        size = max(1, len(raw) - int(count[[9, 10, 11, 12, 13, 32]].sum()))
        insults = [i for i, m in marks if m[0] or m[6]]
        learned = [(i, m) for i, m in marks if m[2]]
        second = np.array([i for i, m in marks if m[1]])
        hits = np.array(sorted({*insults, *(i for i, _ in learned)}))
        near = 0
        if len(second) and len(hits):
            at = np.searchsorted(second, hits)
            before = np.where(at > 0, hits - second[np.maximum(at - 1, 0)], NEAR + 1)
            after = np.where(at < len(second), second[np.minimum(at, len(second) - 1)] - hits, NEAR + 1)
            near = int((np.minimum(before, after) <= NEAR).sum())
        weights = [m[2] for _, m in learned]
        return [
            len(insults) / n, len(insults), len(learned) / n, len(learned), len({m[3] for _, m in learned}), sum(weights), max(weights, default=0.0),
            near / n, len(second) / n, count[65:91].sum() / size, sum(m[4] for _, m in marks) / n, count[33] / size,
            count[[33, 34, 39, 44, 46, 58, 59, 63]].sum() / size, count[[35, 36, 37, 38, 42, 60, 62, 64, 124]].sum() / size,
            count[48:58].sum() / size, sum(m[5] for _, m in marks) / n, sum(m[6] for _, m in marks), math.log1p(len(found)),
        ]


class Trees:
    """Gradient-boosted trees of logistic loss over binned features; deterministic."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 4) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
        self.base = math.log(mean / (1 - mean))
        f = np.full(len(y), self.base)
        self.trees = []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree, leaf = self._grow(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T)], axis=1).astype(np.int64)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        """A complete tree: per inner node the feature and the last bin that goes left; per leaf its step."""
        inner = (1 << self.depth) - 1
        feature, last = np.zeros(inner, np.int64), np.full(inner, self.bins, np.int64)
        node = np.zeros(len(g), np.int64)
        for level in range(self.depth):
            m, first = 1 << level, (1 << level) - 1
            best = np.full(m, 1e-9)
            for j in range(b.shape[1]):
                at = (node - first) * self.bins + b[:, j]
                sums = [np.bincount(at, w, m * self.bins).reshape(m, self.bins).cumsum(axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = sums, (s[:, -1:] for s in sums)
                gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - gt**2 / (ht + self.ridge)
                gain[(nl < self.least) | (nt - nl < self.least)] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(m), k]
                better = top > best
                best[better] = top[better]
                feature[first:first + m][better], last[first:first + m][better] = j, k[better]
            node = 2 * node + 1 + (b[np.arange(len(g)), feature[node]] > last[node])
        leaf = node - inner
        step = self.rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + self.ridge)
        return (feature, last, step), leaf

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f, rows = self._binned(x), np.full(len(x), self.base), np.arange(len(x))
        for feature, last, step in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > last[node])
            f += step[node - len(feature)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on x (pool adjacent violators); between knots it is linear."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, weight, first x, last x
    for a, b in zip(x[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            s, w, _, end = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = end
    xs = np.array([v for s, w, a, b in blocks for v in (a, b)])
    ys = np.array([s / w for s, w, a, b in blocks for _ in (a, b)])
    return xs, ys


class Model:
    """Trees and their calibration, fitted on rows of features and labels."""

    def __init__(self, x: np.ndarray, y: np.ndarray, folds: int = 5) -> None:
        self.constant = float(y[0]) if len(y) and y.min() == y.max() else None if len(y) else 0.0
        if self.constant is not None:
            return
        self.trees = Trees().fit(x, y)
        out = np.empty(len(y))
        fold = np.arange(len(y)) % folds
        for k in range(folds):
            rest = fold != k
            out[~rest] = Trees().fit(x[rest], y[rest]).margin(x[~rest]) if rest.any() and (~rest).any() else self.trees.margin(x[~rest])
        self.knots = isotonic(out, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, with a thousandth of the trees' own scale, which orders what calibration ties."""
        if self.constant is not None:
            return np.full(len(x), self.constant)
        m = self.trees.margin(x)
        return 0.999 * np.interp(m, *self.knots) + 0.001 / (1 + np.exp(-m))


def learn_lexicon(texts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Words and beginnings of words that toxic texts hold far more often than others: texts (text, toxic).

    Texts that hold an entry are counted in Spark, each text once; an entry needs 4 toxic
    texts, log odds of 1.5 and 4 standard errors. The MAX_LEARNED surest are returned.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean, held = Counter(), Counter(), 0
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                (toxic if label else clean).update({s for w in {*(text or "").split()} if (b := bare(w)) and len(b) > 2 for s in stems(b)})
                held += len(text or "")
                if len(toxic) + len(clean) > 2_000_000 or held > 64 << 20:
                    yield out(toxic, clean)
                    toxic, clean, held = Counter(), Counter(), 0
        yield out(toxic, clean)

    def out(toxic: Counter, clean: Counter) -> pa.RecordBatch:
        keys = list({*toxic, *clean})
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic[k] for k in keys], pa.int64()), pa.array([clean[k] for k in keys], pa.int64())], ["entry", "a", "b"])

    c = texts.select("text", "toxic").mapInArrow(count, "entry string, a long, b long").groupBy("entry").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).where("a >= 4")
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n_toxic + 1.0)) - F.log(b / (n_clean + 1.0))
    c = c.select("entry", odds.alias("odds"), (odds / F.sqrt(1 / a + 1 / b)).alias("z")).where("odds > 1.5 and z > 4")
    return {r.entry: r.odds for r in c.orderBy(F.desc("z"), "entry").limit(MAX_LEARNED).collect()}


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every row: (key, held_out, score, predicted) and the columns of `keep`, each row with its own.

    A bounded sample of labelled rows (train_rows at most, by a hash of their key, never a
    held-out one) is fitted: one half teaches the lexicon, the other the trees and, out of
    fold, their calibration. Every text is read once, whole, for its features; labels,
    language, source and key are no features. Labels that repeat a key count as toxic if
    any is; null labels and keys teach nothing.

    Null and empty texts are scored like any other, by all-zero features. Repeated rows get
    equal scores. Without labels every score is 0; with labels of one kind it is that kind.
    An empty table gives an empty result. Columns of docs that are not in `keep`, whose names
    must differ from those above, are left out and are never inputs of a score.
    """
    through = [T.StructField(f"keep{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    read_as, scored_as = (T.StructType([T.StructField("key", docs.schema[key].dataType), *more, *through]) for more in ([T.StructField("x", T.ArrayType(T.DoubleType()))], [T.StructField("score", T.DoubleType())]))
    k = F.col("key")
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("key")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    known = known.join(source.select("key").distinct(), "key", "left_semi")
    sample = materialize(known.orderBy(F.xxhash64("key"), "key").limit(train_rows), "labelled")
    part = F.xxhash64(k, F.lit(1)).bitwiseAND(F.lit(1))
    teach, fit = sample.where(part == 0), sample.where(part == 1)
    n = {r.toxic: r["count"] for r in teach.groupBy("toxic").count().collect()}
    lexicon = learn_lexicon(source.select("key", "text").join(F.broadcast(teach), "key"), n.get(1, 0), n.get(0, 0))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in batches:
            rows = [reader.features(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64())), *batch.columns[2:]], read_as.names)

    features = materialize(source.mapInArrow(read, read_as), "features")
    rows = features.join(F.broadcast(fit), "key").orderBy(F.xxhash64("key"), "key").select("x", "toxic").limit(2 * train_rows).toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    model = Model(x, np.array(rows.column("toxic").to_pylist(), float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            s = np.clip(model.score(x), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *batch.columns[2:]], scored_as.names)

    scored = features.mapInArrow(score, scored_as)
    return scored.select(k.alias(key), held_out(k).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)])
