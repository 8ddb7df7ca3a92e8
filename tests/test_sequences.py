"""Cuts, budgets, lineage and durations against doing them one after the other."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quarry.operators import sequences as Q


@pytest.mark.parametrize("limit", [1, 50, 10_000])
def test_rotations(spark, limit):
    rng = random.Random(limit)
    sizes = {s: [rng.choice([0, 1, 7, 30, 60, None]) for _ in range(n)] for s, n in (("a", 300), ("b", 1), ("c", 40), (None, 20))}
    df = spark.createDataFrame([(s, i * 3, x, "clash") for s, xs in sizes.items() for i, x in enumerate(xs)] + [("a", None, 9, "x")], "scope string, pos long, bytes long, v string")
    want = []
    for s, xs in sizes.items():
        part, held = 0, 0
        for i, x in enumerate(xs):
            if i and held >= limit:
                part, held = part + 1, 0
            held += x or 0
            want.append((s, i * 3, part))
    got = Q.rotations(df, limit)
    assert got.columns == ["scope", "pos", "bytes", "v", "part"]
    key = lambda r: (r[0] is None, r[0] or "", r[1])
    assert sorted(((r.scope, r.pos, r.part) for r in got.collect()), key=key) == sorted(want, key=key)
    assert Q.rotations(df.limit(0)).count() == 0


def naive_budget(texts, cap, total):
    out, left, mark = [], total, "\n\n[truncated]"

    def cut(t, left):
        limit = min(cap, left)
        t = t.strip()
        return t if len(t) <= limit else t[:limit] + mark

    for t in texts:
        if left == 0:
            out.append(None)
            continue
        shown = cut(cut(t or "", left), cap)
        left -= min(len(shown), left)
        out.append(shown)
    return out


@pytest.mark.parametrize("cap, total", [(40, 120), (40, 100), (20, 30), (500, 1000)])
def test_budgets(spark, cap, total):
    rng = random.Random(total)
    for _ in range(2):
        texts = [rng.choice([None, "", " \n "]) if rng.random() < 0.1 else " " * rng.randint(0, 2) + "é" * rng.randint(0, 60) + "\n" for _ in range(12)]
        df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "scope long, pos long, text string")
        assert [r.shown for r in Q.budgeted_texts(df, cap, total).orderBy("pos").collect()] == naive_budget(texts, cap, total)


def test_lineage(spark):
    chain = [(i, i - 1) for i in range(1, 1000)] + [(0, None)]
    odd = [(2000, 2001), (2001, 2002), (2002, 2000), (2003, 2000), (2004, 2003), (3000, 3000), (3001, 9999), (3002, 3001), (3002, 3001), (None, 1)]
    df = spark.createDataFrame(chain + odd, "item long, parent long")
    got = {r.item: (r.root, r.depth, r.in_cycle) for r in Q.lineage(df).collect()}
    assert got == {i: (0, i, False) for i in range(1000)} | {i: (None, None, True) for i in range(2000, 2005)} | {3000: (3000, 0, False), 3001: (3001, 0, False), 3002: (3001, 1, False)}
    tips = spark.createDataFrame([(999,), (5,), (0,), (2004,), (3002,), (77777,)], "item long")
    way = sorted((r.tip, r.depth, r.item) for r in Q.ancestors(df, tips).collect())
    assert way == sorted([(999, d, 999 - d) for d in range(1000)] + [(5, d, 5 - d) for d in range(6)] + [(0, 0, 0), (3002, 0, 3002), (3002, 1, 3001)])
    assert Q.lineage(df.limit(0)).count() == 0


def test_holding(spark):
    t = datetime(2024, 1, 1)
    at = lambda s: t + timedelta(seconds=s)
    rows = [("a", at(0), 1, True), ("a", at(5), 2, True), ("a", at(9), 3, False), ("a", at(20), 4, True), ("b", at(0), 5, None), ("c", at(3), 6, True), ("c", at(3), 7, False), (None, at(0), 8, True), ("d", None, 9, True), ("e", at(10), 1, True)]
    spans = Q.holding(spark.createDataFrame(rows, "key string, ts timestamp, seq long, holds boolean"))
    assert sorted(map(tuple, spans.collect()), key=str) == sorted([("a", at(0), at(9)), ("a", at(20), None), ("e", at(10), None)], key=str)
    due = lambda s, n: sorted((r.key, r.held_s, r.due) for r in Q.held_for(spans, F.lit(at(s)), n).collect())
    assert due(8, 8) == [("a", 8, True)] and due(9, 1) == [] and due(39, 20) == [("a", 19, False), ("e", 29, True)] and due(40, 20) == [("a", 20, True), ("e", 30, True)]
