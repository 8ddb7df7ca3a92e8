"""Streams with state, stopped and started again, against the same rules over all rows at once; and the ledger over several runs."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import ledger
from quarry.streaming import stateful as SF


def in_batches(spark, tmp_path, batches, schema, of):
    """Rows of a query that is started once for each batch."""
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    with SF.rocksdb_state(spark):
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
            found = of(spark.readStream.schema(schema).parquet(path))
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.schema(found.schema).parquet(out).collect()]


def naive_nudges(rows):
    out, seen = [], {}
    for lane, seq, kind, name, original, _ in sorted((r for r in rows if r[0] is not None and r[3] is not None), key=lambda r: r[1]):
        tracked, done = seen.setdefault(lane, ([], set()))
        if kind == "ack":
            done.add(name)
        if kind != "nudge":
            continue
        found = "stale" if name in done else "new"
        for i, o in tracked:
            if found != "new":
                break
            found = "retry" if i == name else "stale" if o == name else "new"
        if name not in [i for i, _ in tracked]:
            tracked.append((name, original))
        out.append((lane, seq, name, found, name if found == "new" else None))
    return out


def test_nudges(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2, None]), i, rng.choice(["nudge"] * 6 + ["ack", "other"]), rng.choice([*"abcdefgh", None]), rng.choice([None, None, *"abcdefgh"]), "x") for i in range(300)]
    got = in_batches(spark, tmp_path, [rows[:100], rows[100:101], rows[101:]], "lane long, seq long, kind string, nudge_id string, original_id string, class string", SF.classify_nudges)
    want = naive_nudges(rows)
    assert {r[3] for r in want} == {"new", "retry", "stale"}
    assert sorted(got, key=lambda r: r[1]) == want


def test_cached_lookups(spark, tmp_path):
    """A hit at 29 seconds and a miss at 30, across batches; a miss drops the completion."""
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    schema = "request string, seq long, kind string, ts timestamp, version string, hit int"
    batches = [
        [("a", 1, "store", at(0), "v1", 0), ("b", 2, "store", at(0), "v1", 0), ("c", 3, "store", at(0), "v0", 0), (None, 4, "store", at(0), "v1", 0), ("d", 5, "lookup", at(0), None, 0), ("e", 6, "store", None, "v1", 0)],
        [("a", 10, "lookup", at(29), None, 0), ("c", 11, "lookup", at(1), None, 0), ("a", 12, "lookup", at(29.999), None, 0)],
        [("a", 20, "lookup", at(30), None, 0), ("b", 21, "lookup", at(30), None, 0)],
        [("a", 30, "store", at(40), "v1", 0), ("a", 31, "store", at(65), "v1", 0), ("a", 32, "lookup", at(80), None, 0)],
        [("a", 40, "lookup", at(94), None, 0), ("z", 41, "store", at(500), "v1", 0)],
        [("a", 50, "lookup", at(510), None, 0), ("z", 51, "lookup", at(510), None, 0)],
    ]
    got = in_batches(spark, tmp_path, batches, schema, SF.cached_lookups)
    assert {r[1]: r[2] for r in got} == {5: False, 10: True, 11: False, 12: True, 20: False, 21: False, 32: True, 40: True, 50: False, 51: True}


def scan(spark, texts):
    rows = [(p, f"h{hash_}", len(t or ""), m, t, "x") for p, (t, hash_, m) in texts.items()]
    return spark.createDataFrame(rows, "path string, content_hash string, size_bytes long, mtime_ms long, text string, run string")


def state(spark, root):
    chunks = {(r.path, r.ordinal): (r.text, r.run) for r in ledger.chunks(spark, root).collect()}
    files = {r.path: (r.chunks, r.run) for r in ledger.files(spark, root).collect()}
    assert {p: sum(1 for q, _ in chunks if q == p) for p in files} == {p: n for p, (n, _) in files.items()}
    return chunks, files


def test_ledger(spark, tmp_path):
    root = f"file://{tmp_path}/index"
    assert ledger.stats(spark, root).first().asDict() == {"files": 0, "chunks": 0, "runs": 0}
    one = {"a": ("x" * 25, 1, 1), "b": ("bb", 2, 1), "c": ("cc", 3, 1), "blank": (" \n", 4, 1), "none": (None, 5, 1)}
    assert ledger.ingest(scan(spark, one), root, size=10, overlap=0) == 1
    assert {p: n for p, (n, _) in state(spark, root)[1].items()} == {"a": 3, "b": 1, "c": 1}
    assert ledger.ingest(scan(spark, one), root, size=10, overlap=0) is None and ledger.runs(spark, root) == [1]
    two = {"a": ("y" * 12, 9, 1), "b": ("bb", 2, 1), "d": ("dd", 6, 2), "c": ("", 7, 2)}
    assert ledger.ingest(scan(spark, two), root, embed=lambda t: F.array(F.length(t)), size=10, overlap=0) == 2
    chunks, files = state(spark, root)
    assert chunks == {("a", 0): ("y" * 10, 2), ("a", 1): ("yy", 2), ("b", 0): ("bb", 1), ("d", 0): ("dd", 2)}
    assert {r.path: list(r.embedding or []) for r in ledger.chunks(spark, root).where("ordinal = 0").collect()} == {"a": [10.0], "b": [], "d": [2.0]}
    # touched only: indexed again; a path that comes back
    three = {"a": ("y" * 12, 9, 5), "b": ("bb", 2, 1), "c": ("again", 8, 9)}
    assert ledger.ingest(scan(spark, three), root, size=10, overlap=0) == 3
    assert {p: r for p, (_, r) in state(spark, root)[1].items()} == {"a": 3, "b": 1, "c": 3}
    assert ledger.truncate(spark, root) == 4 and ledger.truncate(spark, root) is None
    assert state(spark, root) == ({}, {})
    assert ledger.ingest(scan(spark, one), root, size=10, overlap=0) == 5


def test_ledger_broken_run(spark, tmp_path):
    """What a run that broke off has written is never read, and the next attempt replaces it."""
    root = f"file://{tmp_path}/index"
    ledger.ingest(scan(spark, {"a": ("aa", 1, 1)}), root)

    def fails(text):
        raise RuntimeError("no embedder")

    with pytest.raises(RuntimeError):
        ledger.ingest(scan(spark, {"a": ("bb", 2, 1)}), root, embed=fails)
    spark.createDataFrame([("a", "h9", 2, 1, 1)], ledger.FILES).write.parquet(f"{root}/run=2/files")
    assert state(spark, root)[0] == {("a", 0): ("aa", 1)}
    assert ledger.ingest(scan(spark, {"a": ("bb", 2, 1), "b": ("b", 3, 1)}), root) == 2
    assert state(spark, root)[0] == {("a", 0): ("bb", 2), ("b", 0): ("b", 2)}


def test_ledger_repeats(spark, tmp_path):
    """Of rows that share a path the latest counts, of equal rows one; a null path is left out."""
    rows = [("a", "h1", 1, 1, "old"), ("a", "h2", 1, 2, "new"), ("a", "h2", 1, 2, "new"), (None, "h", 1, 1, "t")]
    root = f"file://{tmp_path}/index"
    assert ledger.ingest(spark.createDataFrame(rows, "path string, content_hash string, size_bytes long, mtime_ms long, text string"), root) == 1
    assert state(spark, root) == ({("a", 0): ("new", 1)}, {"a": (1, 1)})
