"""Findings of round 4: the job of frozen_retrieval at size."""

from pyspark.sql import functions as F

from quarry.functions.vectors import letter_shares, letter_shares_at_once
from quarry.operators import frozen as Z
from quarry.operators import index as X
from test_frozen import cosine, naive, shares
from test_index import made


def test_nearest_chunks_meet_tasks_without_a_join(spark):
    """Copies tie beyond the limit, and the smallest chunks stay; no row a pair is made."""
    chunks = [(f"c{i:02}", ["abc", "abd", "xyz", "", "12", "aabbcc"][i % 6]) for i in range(60)]
    tasks = {1: "cab", 2: "", 3: "zz", 4: "fgh"}
    found = Z.nearest_chunks(spark.createDataFrame(chunks, "chunk string, text string").repartition(3), spark.createDataFrame(list(tasks.items()), "query long, text string"), letter_shares, 15)
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    score = {(q, c): round(cosine(shares(x), shares(t)), 9) for c, x in chunks for q, t in tasks.items()}
    want = [(q, c, i) for q in tasks for i, c in enumerate(sorted((c for c, _ in chunks if score[q, c] > 0), key=lambda c: (-score[q, c], c))[:15], 1)]
    assert sorted(map(tuple, found.collect())) == want and {q for q, _, _ in want} == {1, 3}


def test_vectors_of_other_lengths_are_not_near(spark):
    c = spark.createDataFrame([("a", "x"), ("b", "xx"), ("c", None)], "chunk string, text string")
    t = spark.createDataFrame([(7, "xx"), (8, "x")], "query int, text string")
    found = Z.nearest_chunks(c, t, lambda x: F.array_repeat(F.lit(1.0), F.length(x)))
    assert sorted(map(tuple, found.collect())) == [(7, "b", 1), (8, "a", 1)] and found.schema["query"].dataType.simpleString() == "int"


def test_grep_files_finds_what_the_index_finds(spark):
    texts = [*made(5, 40).items(), ("z1", "a b-c TreeTree"), ("z0", "a b-c Tree"), ("z0", "a b-c"), ("zz", None), (None, "Tree"), ("é", "Trée été_x")]
    files = spark.createDataFrame(texts, "path string, text string").repartition(3)
    asked = [(q, k) for q in (1, 2) for k in ("Tree", "e", "Bu", "a b-c", "", "Config", "nowhere", "été", "t_x", "_x")] + [(3, None)]
    queries = spark.createDataFrame(asked, "query long, keyword string")
    for top in (1, 3):
        want = {(q, k, p, i) for q, k in asked if k for i, p in enumerate(sorted({p for p, t in texts if p and t and k in t})[:top], 1)}
        assert set(map(tuple, X.grep_files(files, queries, top).collect())) == want


def test_frozen_retrieval_without_an_index(spark):
    files = made(21, 30)
    chunks = [(f"{p}#{i}", p, part) for p, t in files.items() for i, part in enumerate((t[:len(t) // 2], t[len(t) // 2:]))]
    tasks = {1: "TreeBuilder and Config of Node2", 2: 'File "/app/x/b3.py", line 7\nUnder_score', 3: "", 5: "Parser " * 3 + "regular expression"}
    df, cs, ts = spark.createDataFrame(list(files.items()), "path string, text string"), spark.createDataFrame(chunks, "chunk string, path string, text string"), spark.createDataFrame(list(tasks.items()), "query long, text string")
    got = Z.frozen_retrieval(None, cs, ts, df, letter_shares, top_n=2, top_k=2, budget=60).orderBy("query", "rank").collect()
    want = [(q, *x) for q, t in tasks.items() for x in naive(files, chunks, t, [], 2, 2, 60)]
    assert [(r.query, r["rank"], r.chunk, r.tokens, r.second) for r in got] == want and {x[-1] for x in want} == {True, False}


def test_letter_shares_at_once(spark):
    texts = ["", "abc ABC", "été aé", "zz\n😀", "123"]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", letter_shares("text").alias("a"), letter_shares_at_once("text").alias("b"))
    rows = df.collect()
    assert [r.a for r in rows[:-1]] == [r.b for r in rows[:-1]] and rows[-1].b is None
