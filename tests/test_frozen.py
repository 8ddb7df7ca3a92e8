"""Retrieval in three stages against a version that goes task by task."""

import re

import pytest
from pyspark.sql import functions as F

from quarry.functions.vectors import letter_shares
from quarry.operators import frozen as Z
from quarry.operators import index as X
from test_index import made, naive_expand, naive_grep, naive_keywords


def shares(t):
    return [t.count(c) / max(len(t), 1) for c in "abcdefghijklmnopqrstuvwxyz"]


def cosine(a, b):
    na, nb = sum(x * x for x in a) ** 0.5, sum(x * x for x in b) ** 0.5
    return sum((x / na) * (y / nb) for x, y in zip(a, b)) if na and nb else 0.0


def overlap(a, b):
    a, b = (list(dict.fromkeys(re.split("[^a-z]+", x.lower()))) for x in (a, b))
    both = len(set(a) & set(b))
    return both / (len(a) + len(b) - both)


def naive(files, chunks, task, ppr, top_n, top_k, budget):
    by = {c: (p, t) for c, p, t in chunks}
    near = sorted((c for c, _, t in chunks if round(cosine(shares(t), shares(task)), 9) > 0), key=lambda c: (-round(cosine(shares(by[c][1]), shares(task)), 9), c))[:top_n]
    found = list(near)
    for k in naive_expand(naive_keywords(task)):
        for p in naive_grep(files, k):
            found += sorted(c for c, q, _ in chunks if q == p)
    for named in dict.fromkeys(re.findall(r'File\s+"([^"]+)",\s*line\s+\d+', task)[:5]):
        found += sorted(c for c, p, _ in chunks if p.split("/")[-1] == named.split("/")[-1])
    found = list(dict.fromkeys(found + ppr))

    def pack(cand):
        ranked = sorted(range(len(cand)), key=lambda i: (-round(overlap(task, by[cand[i]][1]), 9), i))[:top_k]
        out, used, seen = [], 0, set()
        for r, i in enumerate(ranked, 1):
            p, t = by[cand[i]]
            if (p, t) in seen:
                continue
            seen.add((p, t))
            used += len(f"# {p}") // 4 + 1 + len(t) // 4 + 1
            if used > budget:
                break
            out.append((r, cand[i], used))
        return out

    first = pack(found)
    grepped = {p for k in naive_keywords(task) for p in naive_grep(files, k)}
    held = {by[c][0] for _, c, _ in first}
    if found and grepped and len(grepped & held) / len(grepped) < 0.3:
        return [(*x, True) for x in pack(found + sorted(c for c, p, _ in chunks if p in grepped - held))]
    return [(*x, False) for x in first]


def test_frozen(spark):
    files = made(21, 50)
    chunks = [(f"{p}#{i}", p, part) for p, t in files.items() for i, part in enumerate((t[:len(t) // 2], t[len(t) // 2:]))]
    tasks = {1: "TreeBuilder and Config of Node2", 2: 'File "/app/x/b3.py", line 7\nUnder_score', 3: "", 4: "zq qz", 5: "Parser " * 3 + "regular expression"}
    ppr = {1: [chunks[5][0], chunks[60][0]], 4: [chunks[8][0]]}
    df, cs, ts = spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame(chunks, "chunk string, path string, text string"), spark.createDataFrame(list(tasks.items()), "query long, text string")
    pr = spark.createDataFrame([(q, c, i) for q, x in ppr.items() for i, c in enumerate(x)], "query long, chunk string, place long")
    index, seconds = X.build_index(df), set()
    for top_n, top_k, budget in ((4, 6, 60), (100, 30, 400), (2, 2, 30)):
        got = Z.frozen_retrieval(index, cs, ts, df, letter_shares, ppr=pr, top_n=top_n, top_k=top_k, budget=budget).orderBy("query", "rank").collect()
        want = [(q, *x) for q, t in tasks.items() for x in naive(files, chunks, t, ppr.get(q, []), top_n, top_k, budget)]
        assert [(r.query, r["rank"], r.chunk, r.tokens, r.second) for r in got] == want
        seconds |= {x[-1] for x in want}
    assert seconds == {True, False}


def test_other_rerankers(spark):
    """Any function of two Columns reranks; too large a batch is refused."""
    cs = spark.createDataFrame([("a", "p", "x"), ("b", "p", "xxxx"), ("c", "q", "xx")], "chunk string, path string, text string")
    ts = spark.createDataFrame([(1, "x")], "query long, text string")
    df = cs.select("path", "text")
    got = Z.frozen_retrieval(X.build_index(df), cs, ts, df, letter_shares, reranker=lambda task, chunk: F.length(chunk).cast("double")).orderBy("rank").collect()
    assert [r.chunk for r in got] == ["b", "c", "a"]
    Z.MAX_TASKS, before = 0, Z.MAX_TASKS
    try:
        with pytest.raises(ValueError):
            Z.nearest_chunks(cs, ts, letter_shares)
    finally:
        Z.MAX_TASKS = before
