"""Phrases, Katz scores and spelling variants against brute-force versions, and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import katz, ngrams, phrases, spelling

SCHEMA = "doc_id long, text string, lang string, n long, batch int, word string, f long, train string"
LONG = "the of, and " * 30_000 + "x" * 100_000


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, 1, 2, "w", 3, "t") for i, t, lang in rows], SCHEMA)


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture
def small(monkeypatch):
    """Many batches and ranges."""
    monkeypatch.setattr(ngrams, "BATCH_BYTES", 4000)
    monkeypatch.setattr(ngrams, "RANGE_BYTES", 20_000)


def prose(seed, n, size=40):
    rng = random.Random(seed)
    names = ["Über", "the", "The", "of", "a", "naïve", " x", "b c", "é"] + [f"w{i}" for i in range(40)]
    weights = [1 / (i + 1) for i in range(len(names))]
    ends = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "!", ";\r\n", "\x0b"]
    return ["".join(w + rng.choice(ends) for w in rng.choices(names, weights, k=rng.randrange(size))) for _ in range(n)]


def naive_phrases(rows, longest=4, least=30, top=2000, pct=80):
    f, n = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n["und" if lang is None else lang] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inner = Counter()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inner[p[i:i + m]] = max(inner[p[i:i + m]], a)
        rows_ = []
        for p, a in cand.items():
            if 100 * inner[p] >= pct * a and inner[p]:
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows_.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        rows_.sort()
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(rows_[:top], 1)]
    return sorted(out)


def test_phrases(spark, small):
    texts = prose(1, 400) + [None, "", " \t\n", "a", "a b", "x y z x y z x y z, x y"] + ["same words, in the same order here"] * 40
    data = [(None if i % 7 == 0 else i, t, [None, "en", "de", "", "und"][i % 5]) for i, t in enumerate(texts)]
    for least, top in ((30, 2000), (3, 25)):
        got = phrases.collocations(docs(spark, data), least=least, top=top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        want = naive_phrases(data, least=least, top=top)
        assert want and sorted(map(tuple, got.collect())) == want


def test_phrases_odd(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None), (2, "", "en")])).count() == 0
    twice = [(1, LONG, "en"), (1, LONG, "en")]
    assert sorted(map(tuple, phrases.collocations(docs(spark, twice)).collect())) == naive_phrases(twice)


def test_suffix_counts_exact():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 50, 400):
        ids = rng.integers(0, 4, n)
        joined = rng.random(n) < 0.8
        joined[-1] = False
        for longest in (1, 2, 3, 4, 7):
            for k, (start, count) in enumerate(phrases.suffix_counts(ids, joined, longest), 1):
                want = Counter(tuple(ids[i:i + k]) for i in range(n - k + 1) if joined[i:i + k - 1].all())
                assert {tuple(ids[i:i + k]): c for i, c in zip(start, count)} == want


def test_phrase_numbers_beyond_64_bits(spark):
    """Products pass 64 bits: 2,000,000 times 6 * 10**12."""
    a = 6_000_000_000_000
    got = spark.createDataFrame([(a, a + 1, a + 2)], "a long, l long, r long").select(F.expr("(2000000BD * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))").alias("s")).first().s
    assert got == 2_000_000 * a // (2 * a + 3)


class Naive:
    """Katz backoff by dictionaries."""

    def __init__(self, texts, order):
        self.order = order
        self.c = [Counter() for _ in range(order + 1)]
        for t in texts:
            x = ["<s>", *self.words(t), "</s>"]
            for n in range(1, order + 1):
                self.c[n].update(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
        self.starts = self.c[1].pop(("<s>",), 0)
        self.d = [None]
        for n in range(1, order + 1):
            r = Counter(self.c[n].values())
            self.d.append(katz.discounts(np.array([r[i] for i in range(1, katz.KATZ + 2)])))
        self.n, self.v = sum(self.c[1].values()), len(self.c[1])
        self.after = defaultdict(list)
        for n in range(2, order + 1):
            for g in self.c[n]:
                self.after[g[:-1]].append(g[-1])

    @staticmethod
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", lower(t))

    def count(self, h):
        return self.starts if h == ("<s>",) else self.c[len(h)][h]

    def reduced(self, g):
        c, d = self.c[len(g)][g], self.d[len(g)]
        return d[c] * c if c <= katz.KATZ else c - katz.KATZ * (1 - d[katz.KATZ])

    def p(self, w, h):
        if not h:
            if not self.n:
                return 1.0
            return self.reduced((w,)) / self.n if self.c[1][(w,)] else 1 - sum(self.reduced(g) for g in self.c[1]) / self.n
        if not self.count(h):
            return self.p(w, h[1:])
        if self.c[len(h) + 1][(*h, w)]:
            return self.reduced((*h, w)) / self.count(h)
        left = 1 - sum(self.reduced((*h, x)) for x in self.after[h]) / self.count(h)
        return left / (1 - sum(self.p(x, h[1:]) for x in self.after[h])) * self.p(w, h[1:])

    def score(self, t):
        x = ["<s>", *self.words(t), "</s>"]
        return sum(math.log10(self.p(x[i], tuple(x[max(0, i - self.order + 1):i]))) for i in range(1, len(x)))


@pytest.mark.parametrize("order", [1, 2, 3])
def test_katz(spark, small, order):
    texts = prose(2, 250) + [None, "", "new words only", "the", "same again"] + ["same again"] * 30
    data = [(i if i % 11 else None, t, "en") for i, t in enumerate(texts)]
    train = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 != 0
    got = katz.katz_scores(docs(spark, data), train, order=order).collect()
    assert len(got) == len(data)
    trained = [zlib.crc32(str("" if i is None else i).encode()) % 3 != 0 for i, _, _ in data]
    model = Naive([t for (_, t, _), y in zip(data, trained) if y], order)
    want = Counter()
    for (i, t, _), y in zip(data, trained):
        w = [*model.words(t), "</s>"]
        base = sum(math.log10((model.c[1][(x,)] + 0.1) / (model.n + 0.1 * (model.v + 1))) for x in w)
        want[i, y, len(w), sum(model.c[1][(x,)] > 0 for x in w), model.n, model.v, round(base, 6), round(model.score(t), 6)] += 1
    assert Counter((r[0], *r[1:6], round(r.base_score, 6), round(r.score, 6)) for r in got) == want


@pytest.mark.parametrize("order", [2, 3])
def test_katz_adds_up(order):
    model = Naive(prose(4, 120), order)
    words = [g[0] for g in model.c[1]] + ["unknown word"]
    for h in [("<s>",), ("the",), ("w0",), ("nothing like it",)] + [h for h in list(model.after) if len(h) == order - 1][:20]:
        assert abs(sum(model.p(w, h) for w in words) - 1) < 1e-9


def test_katz_odd(spark):
    assert katz.katz_scores(docs(spark, []), F.lit(True)).count() == 0
    none = katz.katz_scores(docs(spark, [(1, "a b", "en"), (2, None, None)]), F.lit(None).cast("boolean")).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0)]
    long = katz.katz_scores(docs(spark, [(1, LONG, "en"), (1, LONG, "en")]), F.lit(True)).collect()
    assert len(long) == 2 and long[0].score == long[1].score and long[0].n_tokens == 90_002 and -math.inf < long[0].score < 0


def test_katz_uneven_counts():
    for n in ([0] * 6, [5, 0, 0, 0, 0, 0], [0, 7, 0, 0, 0, 3], [1, 50, 2, 0, 9, 1], [900, 300, 150, 90, 60, 45]):
        d = katz.discounts(np.array(n))
        assert ((0 < d[1:]) & (d[1:] < 1)).all()


def naive_words(rows, every=97):
    c = Counter()
    for i, t, _ in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 5:
                c[w] += 1
    return c


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def naive_variants(c):
    out, form = [], {}
    near = {w: [v for v in c if one_edit(v, w)] for w in c}
    for w in c:
        best = min(near[w], key=lambda v: (-c[v], v), default=None)
        form[w] = best if best is not None and c[best] >= 2 * c[w] else None
    for w in c:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, c[w], len(near[w]), c[form[w]] if form[w] else None))
    return sorted(out)


def made_words(seed, n):
    rng = random.Random(seed)
    found = set()
    while len(found) < n:
        w = "".join(rng.choices("abé×z", k=rng.randrange(5, 9)))
        found.add(w)
    return {w: int(1 + rng.paretovariate(0.7)) for w in sorted(found)}


@pytest.mark.parametrize("bucket", [256, 3])
def test_variants(spark, monkeypatch, bucket):
    monkeypatch.setattr(spelling, "BUCKET", bucket)
    c = made_words(256, 500)
    got = spelling.spelling_variants(spark.createDataFrame([(w, n) for w, n in c.items()] + [(None, 9)], "word string, n long"))
    want = naive_variants(c)
    assert any(w[1] and w[2] != w[1] for w in want)  # chains
    assert sorted(map(tuple, got.collect())) == want


def test_words_of_texts(spark):
    rng = random.Random(5)
    names = ["Straße", "naïveté", "ÉCOLE", "écoleX", "hello", "Hello", "ab", "x×y÷z", "пример", "o'clock", "don’t", "tretiono"]
    texts = [" ".join(rng.choices(names, k=200)) for _ in range(60)] + [None, "", "-- 12 _"]
    data = [(i if i % 9 else None, t, "en") for i, t in enumerate(texts)]
    got = {r.word: r.n for r in spelling.word_counts(docs(spark, data)).collect()}
    assert got == naive_words(data) and got["École".replace("É", "É").replace("cole", "cole")] > 0


def test_variants_odd(spark):
    assert spelling.spelling_variants(spelling.word_counts(docs(spark, []))).count() == 0
    assert spelling.word_counts(docs(spark, [(1, None, "en"), (None, "", None)])).count() == 0
    one = spelling.spelling_variants(spelling.word_counts(docs(spark, [(1, LONG, "en")]))).collect()
    assert [tuple(r) for r in one] == [("x" * 100_000, None, "x" * 100_000, 1, 0, None)]
    twice = spelling.spelling_variants(spark.createDataFrame([("words", 1), ("words", 2), ("wordz", 6)], "word string, n long")).collect()
    assert sorted(map(tuple, twice)) == [("words", "wordz", "wordz", 3, 1, 6), ("wordz", None, "wordz", 6, 1, None)]
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("words", 1)], "word string, n long"), least_ratio=1)
