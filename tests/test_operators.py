from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.vectors import cosine, l2_normalize
from quarry.operators import conversation as C
from quarry.operators import graph as G
from quarry.operators import ingest as I
from quarry.operators import learning as L
from quarry.operators import retrieval as R
from quarry.sources import files as S
from quarry.streaming import streams as ST


def values(df, c="x"):
    return [r[c] for r in df.collect()]


def test_chunks(spark):
    d = spark.createDataFrame([("",), ("a" * 900,), ("a" * 901,), (" " * 10,), ("é" * 2000,)], "t string")
    got = values(d.select(T.chunk_chars(F.col("t")).alias("x")))
    assert [len(x) for x in got] == [0, 1, 2, 0, 3]
    lines = spark.createDataFrame([("\n".join(map(str, range(120))),), ("a\nb\nc\n",), ("",)], "t string")
    got = values(lines.select(T.chunk_lines(F.col("t")).alias("x")))
    assert [(c.line_start, c.line_end) for c in got[0]] == [(1, 50), (41, 90), (81, 120)]
    assert [(c.line_start, c.line_end, c.text) for c in got[1]] == [(1, 3, "a\nb\nc")]
    assert got[2] == []


def test_keywords_and_redaction(spark):
    d = spark.createDataFrame([("call FooBar then my_fn lower x_",)], "t string")
    assert values(d.select(T.keywords(F.col("t")).alias("x"))) == [["FooBar", "my_fn"]]
    d = spark.createDataFrame([("k OPENAI_API_KEY=s3 x",), ("é" * 20000,)], "t string")
    got = values(d.select(T.redact_secrets(F.col("t")).alias("x")))
    assert got[0] == "k OPENAI_API_KEY=[redacted] x"
    assert len(got[1]) == T.FIELD_CHARS and got[1].endswith(T.TRUNCATED)


def test_vectors(spark):
    d = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert values(d.select(cosine(F.col("a"), F.col("b")).alias("x"))) == [pytest.approx(1.0), 0.0, 0.0, 0.0]
    assert values(d.select(l2_normalize(F.col("a")).alias("x")))[0] == [pytest.approx(0.6), pytest.approx(0.8)]


def test_pagerank(spark):
    e = spark.createDataFrame([("a", "b", 1.0, 1.0), ("b", "a", 1.0, 1.0), ("c", "d", 1.0, 1.0)], "source string, target string, weight double, confidence double")
    n = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    r = {x.node: x["rank"] for x in G.personalized_pagerank(e, n, spark.createDataFrame([("a",)], "node string"), rounds=10).collect()}
    assert set(r) == {"a", "b"} and r["a"] > r["b"] and sum(r.values()) == pytest.approx(1.0)
    assert G.personalized_pagerank(e, n, spark.createDataFrame([], "node string"), rounds=2).count() == 0


@pytest.mark.parametrize("n_seeds", [1, 3, 12])
def test_pagerank_rounds(spark, n_seeds):
    """Twenty rounds against a version by dictionaries: nodes without an edge, weights of 0, targets and seeds that are no nodes."""
    import random

    rng = random.Random(n_seeds)
    names = [f"n{i}" for i in range(14)]
    edges = [(rng.choice(names[:9]), rng.choice([*names, "outside"]), rng.choice([0.0, 1.0, 2.5]), rng.choice([0.5, 1.0])) for _ in range(30)] + [("n9", "n1", 0.0, 1.0)]
    seeds = rng.sample([*names, "nowhere"], n_seeds)
    out = {x: [(t, w * c) for s, t, w, c in edges if s == x] for x in names}
    p = {x: 1 / n_seeds if x in seeds else 0.0 for x in names}
    rank = dict(p)
    for _ in range(20):
        lost = sum(rank[x] for x in names if not out[x])
        new = {x: (0.15 + lost) * p[x] for x in names}
        for x in names:
            total = sum(w for _, w in out[x])
            for t, w in out[x]:
                if total > 0 and t in new:
                    new[t] += 0.85 * rank[x] * w / total
        rank = new
    frames = spark.createDataFrame(edges, "source string, target string, weight double, confidence double"), spark.createDataFrame([(x,) for x in names], "node string"), spark.createDataFrame([(x,) for x in seeds], "node string")
    got = {r.node: r["rank"] for r in G.personalized_pagerank(*frames).collect()}
    assert got == pytest.approx({x: r for x, r in rank.items() if r > 0})


def test_learning(spark):
    a = spark.createDataFrame([(1, "x", True), (1, "y", True), (2, "x", False), (2, "y", False), (3, "x", True)], "session long, item string, ok boolean")
    (r,) = L.hebbian_edges(a).collect()
    assert r.alpha == pytest.approx(0.5 + 0.1 * 0.6931471805599453) and r.beta == pytest.approx(1.5 + 0.1 * 0.6931471805599453)
    e = spark.createDataFrame([("k", 0.9), ("m", 0.0), ("m", 1.0)], "kind string, reward double")
    assert sorted(values(L.advantages(e), "advantage")) == [-1.0, 0.5, 1.0]
    d = spark.createDataFrame([(2.0, 3.0)], "a double, b double")
    assert values(d.select(L.beta_entropy(F.col("a"), F.col("b")).alias("x")))[0] == pytest.approx(-0.2349066497879999, abs=1e-4)


def test_conversation(spark):
    rows = [(1, t, "user", "x" * 10) for t in range(5)] + [(1, 5, "user", "y" * 500), (1, 6, "user", "z")]
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in C.chatty_runs(m).collect()] == [(1, 0, 4, 5)]
    assert [tuple(r) for r in C.compaction_split(m.withColumn("role", F.when(F.col("turn") == 3, "tool").otherwise("user"))).collect()] == [(1, 7, 2)]
    s = spark.createDataFrame([(1, "A:\na:\n" + "w " * 700), (2, None)], "id long, text string")
    got = {r.id: r for r in C.compress_summary(s).collect()}
    assert got[1].text.startswith("A:") and got[1].text.endswith("…") and got[2].text == ""


def test_ingest_twice(spark):
    scan = spark.createDataFrame([("a", "h1", 1, 1), ("b", "h2", 2, 2)], "path string, content_hash string, size_bytes long, mtime_ms long")
    empty = scan.limit(0)
    assert I.changed_files(scan, empty).count() == 2
    assert I.changed_files(scan, scan).count() == 0
    assert values(I.stale_files(scan.where("path = 'a'"), scan), "path") == ["b"]


def test_retrieval(spark):
    a = spark.createDataFrame([(1, 2), (2, 1)], "chunk long, pos long")
    b = spark.createDataFrame([(2, 1), (3, 1)], "chunk long, pos long")
    assert sorted(map(tuple, R.union_first([a, b]).collect())) == [(1, 0, 2), (2, 0, 1), (3, 1, 1)]
    d = spark.createDataFrame([(1, i, t, "h") for i, t in enumerate(["x" * 40, "x" * 40, "y" * 400, "z"])], "query long, rank long, text string, header string")
    assert values(R.pack_budget(d, 50), "rank") == [0]  # a repeat is skipped, the first overflow ends the pack


def test_sources(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    (tmp_path / "big.md").write_text("x" * 100)
    (tmp_path / "no.bin").write_text("x")
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "b.md").write_text("x")
    assert values(S.scan_files(spark, str(tmp_path), max_bytes=50), "path") == ["a.md"]
    d = spark.createDataFrame([(1, ": c\nevent: a\ndata: 1\ndata: 2\n\ndata: 3\n\n"), (2, "")], "id long, text string")
    assert sorted(map(tuple, S.parse_sse(d).collect())) == [(1, 1, "a", "1\n2"), (1, 2, "message", "3")]
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{oops\n')
    with pytest.raises(Exception):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a long").collect()


def _stream(spark, tmp_path, batches, schema):
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def _run(df, tmp_path, mode):
    got = []
    q = df.writeStream.foreachBatch(lambda b, n: got.extend(map(tuple, b.collect()))).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_stream_parse(spark, tmp_path):
    df = _stream(spark, tmp_path, [[(1, "data: a\n\nda")], [(1, "ta: b\n\n")]], "id long, piece string")
    got = _run(ST.parse_stream(df), tmp_path, "append")
    assert got[0] == (1, "message", "a")


def test_stream_terminal(spark, tmp_path):
    df = _stream(spark, tmp_path, [[(1, 5, "finished")], [(1, 9, "reconciled")], [(2, 1, "progress")]], "lane long, seq long, event string")
    got = _run(ST.terminal_state(df), tmp_path, "update")
    assert got[-1] == (1, 5, "reconciled") or (1, 5, "reconciled") in got
    assert all(r[0] == 1 for r in got)


def test_stream_heartbeat(spark, tmp_path):
    t = datetime(2024, 1, 1)
    df = _stream(spark, tmp_path, [[(1, t)], [(2, t + timedelta(hours=2))], [(2, t + timedelta(hours=4))]], "lane long, ts timestamp")
    got = _run(ST.heartbeats(df), tmp_path, "update")
    assert (1, "active") in got and (1, "stalled") in got


def test_stream_learning(spark, tmp_path):
    schema = "session long, item string, ok boolean"
    df = _stream(spark, tmp_path, [[(1, "x", True), (1, "y", True)], [(2, "x", False), (2, "y", False)]], schema)
    q = df.writeStream.foreachBatch(ST.learn_batches(str(tmp_path / "steps"))).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    (r,) = ST.learned(spark.read.parquet(str(tmp_path / "steps"))).collect()
    assert r.alpha > 0.5 and r.beta > 1.5


def test_ttl(spark):
    d = spark.createDataFrame([(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 30), 1), (datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 29), 2)], "ts timestamp, now timestamp, k long")
    assert values(ST.fresh_completions(d), "k") == [2]


def test_scope_collisions(spark):
    """Against all pairs; equal scopes collide, siblings and other groups don't."""
    from quarry.operators.policy import scope_collisions

    data = [("x", 1, "a/b"), ("x", 2, "a/b"), ("x", 3, "a"), ("x", 4, "a/c"), ("x", 5, "ab"), ("y", 6, "a/b"), ("x", 1, "a"), ("x", 7, "a/b/c"), (None, 8, "a"), ("y", 9, None), ("x", 2, "a/b")]
    pairs = set()
    for g, o, s in data:
        for h, p, t in data:
            if g and s and t and g == h and o != p and (s == t or s.startswith(t + "/") or t.startswith(s + "/")):
                pairs.add((g, o, min(s, t, key=len), p))
    want = Counter((g, o, s) for g, o, s, _ in pairs)
    got = {(r.g, r.o, r.s): r.others for r in scope_collisions(spark.createDataFrame(data, "g string, o long, s string"), "g", "o", "s").collect()}
    assert got == want


def test_command_intent(spark):
    from quarry.functions.text import command_intent

    want = {"dd if=a of=b": "write", "rm x": "destructive", "shred x": "destructive", "mkfs x": "unknown", "less x": "read_only", "rsync a b": "network", "apt-get x": "package", "ps": "process",
            "A=1 B='c d' cat x": "read_only", "A=1": "unknown", "git stash": "read_only", "git -p push": "write", "git": "write", "sed -i x": "write", "su": "system_admin", "": "unknown"}
    d = spark.createDataFrame([(c,) for c in want], "c string")
    assert {r.c: r.i for r in d.select("c", command_intent(d.c).alias("i")).collect()} == want


def test_scan_lists(spark, tmp_path):
    """Only a file that is too large itself is left out, whatever its extension in the lists; folders by name, files not."""
    for x in ("tsx", "hpp", "kt", "ps1", "pyx", "mm"):
        (tmp_path / f"a.{x}").write_text("x")
    for x in ("build", "vendor", ".index"):
        (tmp_path / x).mkdir()
        (tmp_path / x / "b.hpp").write_text("x")
    (tmp_path / "build.rs").write_text("x")
    (tmp_path / "large.rs").write_text("x" * 300_000)
    paths = lambda *a, **k: {r.path for r in S.scan_files(spark, str(tmp_path), *a, **k).collect()}
    assert paths() == {"a.tsx", "a.hpp", "a.kt", "a.ps1", "build/b.hpp", "vendor/b.hpp", "build.rs", "large.rs"}
    assert paths(S.CODE_EXTENSIONS, 256 << 10, 10, S.CODE_SKIPPED) == {"a.tsx", "a.hpp", "a.kt", "a.pyx", "a.mm", "build.rs"}
    assert paths(skipped=(*S.SKIPPED, "vendor"), max_depth=1) == {"a.tsx", "a.hpp", "a.kt", "a.ps1", "build.rs", "large.rs"}


def test_bootstrap(spark):
    """Against the same draws made one by one."""
    import hashlib

    values = [(i, float(i * i % 17)) for i in range(0, 130, 3)] + [(500, None)]
    df = spark.createDataFrame(values, "k long, v double")
    x, means = [v for _, v in values if v is not None], []
    for r in range(40):
        draws = [x[int(hashlib.md5(f"{r},{j}".encode()).hexdigest()[:15], 16) % len(x)] for j in range(len(x))]
        means.append(sum(draws) / len(draws))
    means.sort()
    got = L.bootstrap_interval(df, "k", "v", resamples=40, level=0.9, block=7).first()
    assert abs(got.low - means[2]) < 1e-9 and abs(got.high - means[38]) < 1e-9
    assert L.bootstrap_interval(df.where("false"), "k", "v").first().low is None
    assert [r.i for r in L.numbered(df, "k").orderBy("k").collect()] == list(range(len(values)))
