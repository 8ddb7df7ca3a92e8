"""Every operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from compare import duck, rows
from pyspark.sql import functions as F

from quarry.llm import ann, html, oracles, packing, quality, queries, segment, simhash, substring, toxicity, urlfilter, warc
from quarry.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, batch int, _text string"
LONG = "the of and " * 20_000
TEXTS = [None, "", "  \n\t", "one", "one two", "Ünï cödé 中文  x", "a b c d e f g h i j k l m n o p q r s t u v", "a b c d e f g h i j k l m n o p q r s t u v", LONG, "x" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    data = [(i, t, None if i % 3 else "en", None, None, "k", "f", 1, "t") for i, t in enumerate(TEXTS)]
    data += [(6, TEXTS[6], "en", "s", 1, "k", "f", 1, "t"), (None, "null key text", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_oracle(spark, sf, name):
    assert rows(queries.queries()[name](spark, sf).toPandas()) == rows(duck(sf, oracles.oracle_sql()[name]))


def test_quality(spark, odd, none):
    got = {r.doc_id: r for r in quality.quality_rules(odd).collect()}
    for i, t in enumerate(TEXTS):
        w = words(t)
        grams = Counter(tuple(w[j:j + 3]) for j in range(len(w) - 2))
        cover = {j + k for j in range(len(w) - 2) if grams[tuple(w[j:j + 3])] > 1 for k in range(3)}
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert not got[i].kept
    assert quality.quality_rules(odd).count() == odd.count()
    assert quality.quality_rules(none).count() == 0


def test_quality_bits_that_clash(spark, monkeypatch):
    """With a hash of few bits every row takes the exact way and counts alike."""
    d = spark.createDataFrame([(1, "a b c d a b c e f g " * 3 + "h i j k l m"), (2, " ".join(map(str, range(300))))], "doc_id long, text string")
    want = [r.n_repeat_words for r in quality.base_counts(d, keep=("doc_id",)).orderBy("doc_id").collect()]
    monkeypatch.setattr(quality, "POS_BITS", 61)
    assert [r.n_repeat_words for r in quality.base_counts(d, keep=("doc_id",)).orderBy("doc_id").collect()] == want


def naive_fp(t, k=3):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_simhash(spark, odd, none):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(TEXTS[:8]):
        assert by[i].fp % (1 << 64) == naive_fp(t)
    assert [by[i].component_id for i in (0, 1, 2)] == [0, 0, 0] and by[7].component_id == 6
    assert simhash.simhash_groups(none).count() == 0
    assert simhash.near_dedup(none).count() == 0
    kept = simhash.near_dedup(odd)
    assert kept.columns == odd.columns and 0 in {r.doc_id for r in kept.collect()} and 7 not in {r.doc_id for r in kept.collect()}


@pytest.mark.parametrize("bucket", [512, 20])
def test_simhash_links(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, vals = random.Random(bucket), set()
    base = rng.getrandbits(64)
    for _ in range(400):
        c = base
        for _ in range(rng.randint(0, 6)):
            c ^= 1 << rng.randrange(64)
        vals.add(c)
        vals.add(rng.getrandbits(64))
    a = np.array(sorted(vals), np.uint64)
    label = np.arange(len(a))
    near = np.bitwise_count(a[:, None] ^ a[None, :]) <= 2
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    df = spark.createDataFrame([(i, int(x)) for i, x in enumerate(a.view(np.int64))], "node long, fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    assert [got.get(i, i) for i in range(len(a))] == label.tolist()


def test_components(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 100), (None, 5), (60, 61), (61, 60)], "a long, b long")
    got = {r.node: r.component for r in connected_components(chain).collect()}
    assert got == {**{i: 0 for i in range(41)}, 60: 60, 61: 60}


def naive_cut(data, window=20):
    seen, out = set(), {}
    for k, t in data:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            x = tuple(w[i:i + window])
            if x in seen:
                gone[i:i + window] = [True] * window
            seen.add(x)
        out[k] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g))
    return out


@pytest.mark.parametrize("batch", [4 << 20, 30_000])
def test_substring(spark, odd, none, monkeypatch, batch):
    monkeypatch.setattr(substring, "BATCH_BYTES", batch)
    got = substring.substring_dedup(odd.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == naive_cut(enumerate(TEXTS))
    for r in got:
        assert sum(s.end - s.start for s in r.removed) == r.n_removed
    all_rows = substring.substring_dedup(odd).collect()
    assert len(all_rows) == odd.count()
    assert sorted(r.n_removed for r in all_rows if r.doc_id == 6) == [0, 22]
    assert substring.substring_dedup(none).count() == 0


def test_packing(spark, odd, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    e = packing.WordEncoder(path)
    for x in [*TEXTS, "it's we'LL <|endoftext|> a<|startoftext|>b", "İ Σς ﬁ é x y", "'s'S"]:
        assert np.frombuffer(e.encode(x or ""), "<u4").tolist() == t.encode(x or "", add_special_tokens=False).ids
    got = packing.harmonic_pack(odd.where("doc_id is not null").dropDuplicates(["doc_id"]), path).toPandas()
    for k, p in got.groupby("doc_id"):
        ids = t.encode(TEXTS[k] or "", add_special_tokens=False).ids + [1]
        p = p.sort_values("start")
        assert b"".join(p.ids) == np.array(ids, "<u4").tobytes() and (p.doc_tokens == len(ids)).all()
    for _, p in got.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p.offset.tolist() == [0, *p.length.cumsum().tolist()[:-1]] and p.length.sum() <= 2048
    assert packing.harmonic_pack(odd, path).select("doc_id", "start").count() >= odd.count()
    assert packing.harmonic_pack(none, path).count() == 0
    for n in (1, 63, 64, 700, 2047, 2048, 5000):
        assert sum(s for s, _ in packing.cut(n, 2048)) == n and all(s * k <= 2048 for s, k in packing.cut(n, 2048))


def test_toxicity(spark, odd, none):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    data = []
    for i in range(900):
        w = [rng.choice(vocabulary) for _ in range(60)]
        if i % 5 == 0:
            for j in rng.sample(range(60), 3):
                w[j] = rng.choice(["zorgish", "moron", "zorgly"])
        data.append((i, " ".join(w)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(900)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    r = toxicity.toxicity_scores(d, labels).toPandas()
    held = r[r.held_out]
    assert ((held.doc_id % 5 == 0).astype(int) == held.predicted).mean() > 0.97
    assert (r.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in r.doc_id]).all()
    s = toxicity.toxicity_scores(odd, labels).collect()
    assert len(s) == odd.count() and all(0 <= x.score <= 1 for x in s)
    assert {x.score for x in toxicity.toxicity_scores(odd, labels.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity_scores(none, labels).count() == 0


def test_isotonic():
    x, y = toxicity.isotonic(np.array([1.0, 2.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    assert (np.diff(y) >= 0).all() and np.interp(4.0, x, y) == 1.0


def test_nearest(spark, sf):
    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    bad = spark.createDataFrame([(10_000, None), (10_020, [0.0] * 64), (10_040, [float("nan")] * 64), (10_060, [1.0] * 3), (None, [1.0] * 64), (10_080, [None] * 64)], "vec_id long, embedding array<float>")
    v = e.select("vec_id", "embedding").unionByName(bad).unionByName(e.select((F.col("vec_id") + 100_000).alias("vec_id"), "embedding").where("vec_id < 100050"))
    got = ann.nearest(v, F.col("vec_id") % 20 == 0).toPandas()
    p = v.where("vec_id < 10000 or vec_id >= 100000").toPandas().sort_values("vec_id")
    ids, x = p.vec_id.to_numpy(), np.stack(p.embedding.to_numpy()).astype(float)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = ann.exact_scores(np.repeat(x[q:q + 1], len(x), axis=0), x)
        s[q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        mine = got[got.query_id == ids[q]].sort_values("rank")
        hits += len(set(ids[best]) & set(mine.vec_id))
        total += 20
        np.testing.assert_allclose(mine.score, [s[np.flatnonzero(ids == i)[0]] for i in mine.vec_id], rtol=0, atol=0)
    assert hits / total >= 0.9
    assert ann.nearest(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_routing():
    """Vectors that the index was not fitted on: with several parts and fewer probes, nine tenths of their neighbours lie in the parts they try."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 2
    x = centres[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 16)) * 0.4
    for n, parts in ((150, 1), (500, 5), (3000, 5)):
        index = ann.Index(x[:n], 20)
        assert index.n_parts == parts and index.probes <= parts
        own, tried = index.parts(x)[:, 0], index.parts(x[-300:])
        s = x[-300:] @ x.T
        s[np.arange(300), np.arange(5700, 6000)] = -np.inf
        near = np.argsort(-s, axis=1)[:, :20]
        assert np.mean([(np.isin(own[b], t)).mean() for b, t in zip(near, tried)]) >= 0.9
        assert n < 3000 or index.probes < parts


def test_balanced_parts():
    rng = np.random.default_rng(0)
    graph = np.concatenate([rng.integers(0, 50, (50, 5)), rng.integers(50, 100, (50, 5))])
    label = ann.balanced_parts(graph, 2)
    assert np.bincount(label).tolist() == [50, 50] and len(set(label[:50])) == 1
    sizes = np.bincount(ann.balanced_parts(rng.integers(0, 103, (103, 5)), 5))
    assert sizes.max() - sizes.min() <= 2


def test_segmentations(spark, odd, none):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    v = segment.vocabulary(path)
    parts = ["▁the", "▁tion"]

    def every(w):
        if not w:
            yield (), 0.0
        for j in range(1, len(w) + 1):
            if f := v.ids.get(w[:j]):
                for r, p in every(w[j:]):
                    yield (f[0], *r), f[1] + p

    weights = {a + b: p + q for a, p in every(parts[0]) for b, q in every(parts[1])}
    z = np.logaddexp.reduce(list(weights.values()))
    n, first, second = 3000, Counter(), Counter()
    sampler = segment.Sampler(pa.array(["the tion"] * n), np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64), v)
    held, limit = sampler.samples(3)
    got = [[(tuple(sampler.lattice.ids[p.edges[a:b]].tolist()), q, t) for a, b, q, t in zip(p.first, p.first[1:], p.log_prob, p.top)] for p in held]
    for one, two, three, rest in zip(*got, limit):
        assert len({one[0], two[0], three[0]}) == 3 and one[2] >= two[2] >= three[2] >= rest
        for ids, p, _ in (one, two, three):
            assert p == pytest.approx(weights[ids] - z)
        first[one[0]] += 1
        second[two[0]] += 1
    chance = {s: np.exp(w - z) for s, w in weights.items()}
    for s in sorted(chance, key=chance.get)[-3:]:
        assert first[s] / n == pytest.approx(chance[s], abs=0.02)
        assert second[s] / n == pytest.approx(sum(chance[o] * chance[s] / (1 - chance[o]) for o in chance if o != s), abs=0.04)
    few, limit = segment.Sampler(pa.array(["", "a"]), np.array([1, 2], np.uint64), v).samples(50)
    every_a = {a for a, _ in every("▁a")}
    assert {tuple(segment.spelled_ids(np.array([v.ids["▁"][0]]), np.array([0, 1]), v)[0].tolist())} == {a for a, _ in every("▁")}
    assert sum(0 in p.rows for p in few) == 1 and sum(1 in p.rows for p in few) == len(every_a) and (limit == -np.inf).all()
    some = odd.where("text is null or length(text) < 10000")
    out = segment.decode_segmentations(segment.sample_segmentations(some, path), path)
    for r in out.join(some.select("doc_id", F.col("text").alias("t")).distinct(), "doc_id").collect():
        assert r.decoded == (r.t or "") and 0 <= r.inclusion <= 1
    assert segment.sample_segmentations(none, path).count() == 0
    a, b = (sorted((r.doc_id, r["rank"], r.n_pieces) for r in segment.sample_segmentations(x, path).where("doc_id is not null").collect()) for x in (some, some.repartition(7)))
    assert a == b


def test_urls(spark):
    c = spark.createDataFrame([(1, "http://a.x.com/p/q?z", 100), (2, "http://u@X.com:80/", 250), (3, "nonsense", 100), (4, None, 100), (5, "http://x.com", None), (1, "http://a.x.com/p/q?z", 100), (6, "http://ax.com/", 100)], "page_id long, url string, fetched long")
    e = spark.createDataFrame([("d:x.com", 50, "add", "s"), ("d:x.com", 200, "remove", "s"), ("d:x.com", 50, "add", "s"), ("p:a.x.com/p", 0, "add", "t"), (None, 0, "add", "t"), ("d:x.com", None, "add", "t"), ("d:a.x.com", 100, "add", "u"), ("d:a.x.com", 100, "remove", "u")], "key string, ts long, action string, category string")
    got = sorted((r.page_id, r.blocked, r.n_matches, r.matched_key) for r in urlfilter.filter_urls(c, e).collect())
    assert got == [(1, True, 2, "a.x.com/p"), (1, True, 2, "a.x.com/p"), (2, False, 0, None), (3, False, 0, None), (4, False, 0, None), (5, False, 0, None), (6, False, 0, None)]
    assert urlfilter.filter_urls(c, e.limit(0)).where("blocked").count() == 0
    assert urlfilter.filter_urls(c.limit(0), e).count() == 0


def test_warc(spark, tmp_path):
    big = "é" * 600
    pages = spark.createDataFrame([(1, "http://a/ b\r\nX: y", big), (2, None, big), (9, "u", big), (3, "u", "small"), (4, "u", "small"), (5, "u", None), (None, "u", big), (7, "u", "<p>\r\n\r\nWARC/1.1\r\n\r\n" * 100)], "page_id long, url string, html string")
    got = warc.warc_round_trip(pages, str(tmp_path / "w")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == 8 and (by[1].record_type, by[1].refers_to) == ("revisit", 9) and by[9].record_type == "response" and by[None].record_type == "response"
    assert by[3].record_type == by[4].record_type == "response" and by[5].payload_bytes == 0
    assert by[1].payload_digest == hashlib.sha1(big.encode()).hexdigest() and by[1].payload_bytes == 1200
    assert bytes(by[7].payload) == ("<p>\r\n\r\nWARC/1.1\r\n\r\n" * 100).encode()
    only = warc.read_warc(spark, str(tmp_path / "w")).where("record_type = 'revisit'")
    assert sorted(r.page_id for r in only.collect()) == [1, 2]
    assert warc.warc_round_trip(pages.limit(0), str(tmp_path / "v")).count() == 0
    reader = warc.Members(io.BytesIO(b"WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\n"))
    assert reader.head()["content-length"] == "3" and reader.body(3, True) == b"abc" and reader.head()["content-length"] == "0" and reader.body(0, True) == b"" and reader.head() is None


def test_html(spark):
    crf = html.trained()
    right = total = 0
    for blocks, want in html.labelled_pages(150, 4242):
        got = crf.decode(html.features(blocks))
        right += sum(a == b for a, b in zip(got, want))
        total += len(want)
    assert right / total > 0.98
    page = '<html><head><title>t</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">One</a></li></ul></nav><article><h1>A  head</h1><p><b>First&amp;\n part.<br><p>Second part of it.</p></article><footer>&copy; x</footer>'
    pages = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (None, "u", page)], "page_id long, url string, html string").withColumn("text", F.lit("x"))
    got = {r.page_id: r for r in html.extract_main_text(pages).collect()}
    assert got[1].text == got[None].text == "A head\nFirst& part.\nSecond part of it." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == "" and got[2].n_chars == 0
    assert html.extract_main_text(pages.limit(0)).count() == 0


def test_crf_by_enumeration():
    """Viterbi and the gradient's expectations against all labellings of a short page."""
    import itertools

    crf, rng = html.Crf(), np.random.default_rng(1)
    crf.w[:9], crf.t[:] = rng.normal(size=(9, 2)), rng.normal(size=(2, 2))
    x = [[0, 3], [1], [2, 5, 8], [7]]
    score = {y: sum(crf.w[x[i]].sum(axis=0)[y[i]] for i in range(4)) + sum(crf.t[y[i], y[i + 1]] for i in range(3)) for y in itertools.product((0, 1), repeat=4)}
    assert tuple(crf.decode(x)) == max(score, key=score.get)
    z = np.logaddexp.reduce(list(score.values()))
    expected = sum(np.exp(s - z) * np.eye(2)[list(y)] for y, s in score.items())
    node, _ = crf.gradient(x, [0, 0, 0, 0])
    np.testing.assert_allclose(node, np.eye(2)[[0] * 4] - expected, atol=1e-9)


def test_pipeline(spark, sf):
    """Stages against brute force on the smallest tables: what each takes away follows from its operator's rows."""
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    names = []
    for name, stage in cp.STAGES:
        names.append(name)
        new = stage(spark, docs, sf).toPandas()
        if name != "packing":
            assert list(new.columns) == columns and set(new.doc_id) <= ids
            ids = set(new.doc_id)
        if name == "substring dedup":
            want = naive_cut(sorted((r.doc_id, r.text) for r in docs.collect()))
            for r in new.itertuples():
                assert r.text.split() == want[r.doc_id][2].split() and r.n_chars == len(r.text)
        if name == "packing":
            assert set(new.doc_id) == ids
        else:
            docs = spark.createDataFrame(new, docs.schema)
    assert names == ["quality rules", "toxicity", "near duplicates", "substring dedup", "packing"]


def test_near_copies(spark, sf, odd, none):
    """Groups of the pipeline's near-duplicate stage are the components of all pairs of 5-word Jaccard 0.8 or more."""
    import corpus_pipeline as cp
    from quarry.llm import nearcopies

    rng = random.Random(5)
    base = [rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(60, 200)) for _ in range(30)]
    texts = {i: " ".join(w) for i, w in enumerate(base)}
    for i, w in enumerate(base):
        texts[100 + i] = " ".join(w[:30] + ["X"] + w[31:])
        texts[200 + i] = " ".join(w[: len(w) - i])
    texts |= {1000 + r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sets = {i: {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} for i, t in texts.items() for w in [words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]}
    group, near = {i: i for i in sets}, [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8]
    assert sum(sets[a] != sets[b] for a, b in near) > 30
    for _ in sets:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in cp.near_duplicates(spark, d, sf).collect()} == set(group.values())
    assert {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(d).collect()} == group
    by = {r.doc_id: r.component_id for r in nearcopies.near_copy_groups(odd).collect()}
    assert [by[i] for i in (0, 1, 2, 7)] == [0, 0, 0, 6] and by[None] in (None, 0)
    assert nearcopies.near_copy_dedup(none).count() == 0 and nearcopies.near_copy_dedup(odd).columns == odd.columns


def test_urls_of_any_depth(spark):
    """A host of 7 labels and a path of 5 segments can be listed."""
    c = spark.createDataFrame([(1, "http://a.b.c.d.e.x.com/", 100), (2, "http://y.com/1/2/3/4/5/6?q", 100), (3, "http://b.c.d.e.x.com/", 100), (4, "http://y.com/1/2/3/4/6", 100)], "page_id long, url string, fetched long")
    e = spark.createDataFrame([("d:a.b.c.d.e.x.com", 50, "add", "s"), ("p:y.com/1/2/3/4/5", 50, "add", "s")], "key string, ts long, action string, category string")
    got = sorted((r.page_id, r.blocked, r.matched_key) for r in urlfilter.filter_urls(c, e).collect())
    assert got == [(1, True, "a.b.c.d.e.x.com"), (2, True, "y.com/1/2/3/4/5"), (3, False, None), (4, False, None)]


def test_urls_of_addresses_and_hostile_ones(spark):
    """IPv6 and IPv4 hosts have no parents, ports and users don't count, and URLs of 1 MB end."""
    deep, wide = "http://y.com/" + "a/" * 500_000, "http://" + "a." * 500_000 + "y.com/"
    urls = ["http://[2001:db8::1]/x", "http://u@[2001:DB8::1]:80/x/y", "http://[2001:db8::2]/", "http://1.2.3.4/", "http://9.2.3.4/", "http://y.com:8080/a", deep, wide, "http://[2001/x", "http://x.y.com./a/a"]
    c = spark.createDataFrame([(i, u, 100, "clash", True, 7) for i, u in enumerate(urls)], "page_id long, url string, fetched long, key string, blocked boolean, _slice int")
    e = spark.createDataFrame([(k, 50, "add", "s", "clash") for k in ("d:[2001:db8::1]", "d:2.3.4", "d:1.2.3.4", "p:y.com/a/a", "d:a.y.com", "p:[2001:db8::1]/x/y")], "key string, ts long, action string, category string, _host string")
    got = {r.page_id: (r.n_matches, r.matched_key) for r in urlfilter.filter_urls(c, e).collect()}
    assert got == {0: (1, "[2001:db8::1]"), 1: (2, "[2001:db8::1]/x/y"), 2: (0, None), 3: (1, "1.2.3.4"), 4: (0, None), 5: (0, None), 6: (1, "y.com/a/a"), 7: (1, "a.y.com"), 8: (0, None), 9: (0, None)}


def test_bit_sliced_comparison():
    """Wide fingerprints compared by planes and carry-save counters against plain counts of differing bits."""
    from quarry.llm import nearcopies

    rng = np.random.default_rng(0)
    base = rng.integers(0, 256, nearcopies.BITS // 8, np.uint8)
    prints = []
    for i in range(300):
        bits = np.unpackbits(base)
        bits[rng.choice(nearcopies.BITS, int(rng.integers(0, nearcopies.BITS if i % 2 else 90)), replace=False)] ^= 1
        prints.append(np.packbits(bits))
    prints = np.stack(prints)
    far = np.bitwise_count(prints[:, None] ^ prints[None]).sum(axis=2)
    group = np.sort(rng.integers(0, 40, len(prints)))
    for radius in (0, 1, nearcopies.radius_for(0.8), nearcopies.BITS - 1, nearcopies.BITS):
        got = zip(*(x.tolist() for x in nearcopies.across(prints[:130], prints, radius)))
        assert sorted(got) == [tuple(x) for x in np.argwhere(far[:130] <= radius).tolist()]
        got = zip(*(x.tolist() for x in nearcopies.side_by_side(group, prints, radius)))
        assert sorted(got) == [(a, b) for a, b in np.argwhere(far <= radius).tolist() if a < b and group[a] == group[b]]


def test_urls_at_odd_times(spark):
    """Fetch times far off and below zero are judged like any other; open entries take no slice that no capture has."""
    times = [-(1 << 62), -1, 0, 100, 253402300799, 1 << 62]
    c = spark.createDataFrame([(i, "http://x.com/", t) for i, t in enumerate(times)], "page_id long, url string, fetched long")
    e = spark.createDataFrame([("d:x.com", 50, "add", f"s{i}") for i in range(200)] + [("d:x.com", -5, "add", "o"), ("d:x.com", 1, "remove", "o")], "key string, ts long, action string, category string")
    got = {r.page_id: r.n_matches for r in urlfilter.filter_urls(c, e).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 200, 4: 200, 5: 200}


def test_pipeline_rows_apart(spark, sf):
    """Rows that share a doc_id, or have none, are judged, cut and kept each by its own text; extra columns stay."""
    import corpus_pipeline as cp

    rng = random.Random(3)
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text and 120 < len(r.text.split()) < 400 and r.lang == "en"]
    judged = {r.doc_id: r.kept for r in quality.quality_rules(spark.createDataFrame(list(enumerate(good)), "doc_id long, text string").selectExpr("*", "'en' lang")).collect()}
    a, b, c = [t for i, t in enumerate(good) if judged[i]][:3]
    shared = " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(40))
    data = [(5, "junk", "en", "s", 4, 1), (5, a, "en", "s", len(a), 2), (None, "junk", "en", "s", 4, 3), (None, b, "en", "s", len(b), 4), (9, c, "en", "s", len(c), 5), (9, None, "en", None, None, 6)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, kept int")
    assert sorted(r.kept for r in cp.quality(spark, docs, sf).collect()) == [2, 4, 5]
    assert cp.toxicity(spark, docs, sf).columns == docs.columns
    assert cp.toxicity(spark, docs.limit(0), sf).count() == cp.quality(spark, docs.limit(0), sf).count() == cp.substrings(spark, docs.limit(0), sf).count() == 0
    scored = {(r.doc_id, r.n): r.predicted for r in toxicity.toxicity_scores(docs.withColumnRenamed("kept", "n"), spark.read.parquet(f"{sf}/labels.parquet"), keep=("n",)).collect()}
    assert sorted(r.kept for r in cp.toxicity(spark, docs, sf).collect()) == sorted(n for (_, n), p in scored.items() if p == 0) and len(scored) == 6

    data = [(5, "x " + shared + " one  two", "en", "s", 1, 1), (5, "y three", "en", "s", 1, 2), (None, shared, "en", "s", 1, 3), (None, "z  kept as is", "en", "s", 1, 4), (7, "four " + shared, "en", "s", 1, 5), (7, None, "en", "s", None, 6)]
    got = {r.kept: r.text for r in cp.substrings(spark, spark.createDataFrame(data, docs.schema), sf).collect()}
    assert got == {1: "x one two", 2: "y three", 3: shared, 4: "z  kept as is", 5: "four", 6: None}
