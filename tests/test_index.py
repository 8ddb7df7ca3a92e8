"""Keyword search over an index, expansion and two rounds against plain versions."""

import random
import re

import pytest

from quarry.functions.expansions import DOMAIN_TERMS, SYNONYMS
from quarry.functions.text import import_files
from quarry.operators import index as X


def naive_keywords(text, limit=8, least=3):
    found = [k for k in re.findall(r"[A-Za-z_][A-Za-z0-9_]+", text) if len(k) >= least and re.search("[A-Z_]", k)]
    found.sort(key=len, reverse=True)
    return [k for i, k in enumerate(found) if i == 0 or k != found[i - 1]][:limit]


def naive_expand(keywords, limit=20):
    seen, out = set(), []
    for k in keywords:
        low = k.lower()
        if low not in seen:
            seen.add(low)
            out.append(k)
        for name in sorted(DOMAIN_TERMS):
            if name in low:
                for t in DOMAIN_TERMS[name]:
                    if t not in seen:
                        seen.add(t)
                        out.append(t)
                        if len(out) >= limit:
                            return out
        for a, b in SYNONYMS:
            other = b if low == a else a if low == b else None
            if other and other not in seen:
                seen.add(other)
                out.append(other)
        if len(out) >= limit:
            break
    return out


def naive_grep(files, keyword, top=5):
    return [p for p in sorted(files) if keyword in files[p]][:top]


def made(seed, n=60):
    rng = random.Random(seed)
    names = ["Parser", "parse", "TreeBuilder", "tree_builder", "x", "ab", "Node2", "regular expression", "error", "exception", "flask", "Ünder_score", "a.b", "Config"]
    return {f"src/{i:02d}/{rng.choice('abc')}{i}.py": "\n".join(rng.choice(["", "import ", "from "]) + " ".join(rng.choices(names, k=rng.randint(0, 5))) for _ in range(rng.randint(0, 6))) for i in range(n)}


@pytest.mark.parametrize("block", [1024, 4])
def test_grep(spark, block):
    files = made(block)
    df = spark.createDataFrame([*files.items(), ("none.py", None), (None, "Parser")], "path string, text string")
    words = ["Parser", "arse", "e", "ee", "TreeB", "tree_builder", "2", "regular expression", "a.b", "zzz", "Node2 ", "_", "Con", "..", ""]
    queries = spark.createDataFrame([(i % 3, w) for i, w in enumerate(words)] + [(9, "Parser"), (9, "Parser")], "query long, keyword string")
    got = {}
    for r in X.grep_index(X.build_index(df, block), queries, files=df).orderBy("place").collect():
        got.setdefault((r.query, r.keyword), []).append(r.path)
    want = {(i % 3, w): naive_grep(files, w) for i, w in enumerate(words)} | {(9, "Parser"): naive_grep(files, "Parser")}
    assert got == {k: v for k, v in want.items() if v and re.search("[A-Za-z0-9_]", k[1])}


def test_expand(spark):
    lists = [["MyDjangoView"], ["django", "flask", "sympy"], ["validate", "validator"], ["Regex", "regex", "REGEX"], ["a1", "b2"] * 3, [f"Word{i}" for i in range(19)] + ["validate", "log"], [f"Word{i}" for i in range(19)] + ["flask", "Z9"], [f"Word{i}" for i in range(15)] + ["cache", "scikit_sphinx_x", "Q"], [], ["sqlalchemy_pandas_pytest"], [f"W{i}" for i in range(30)]]
    k = spark.createDataFrame([(q, i, w) for q, ws in enumerate(lists) for i, w in enumerate(ws)], "query long, pos long, keyword string")
    got = {}
    for r in X.expand_keywords(k).orderBy("pos").collect():
        got.setdefault(r.query, []).append(r.keyword)
    assert got == {q: naive_expand(ws) for q, ws in enumerate(lists) if ws}


def test_two_rounds(spark):
    files = made(11, 40)
    files["lib/errors.py"] = "from pkg.mod import Thing\nimport os, sys\n import  \nclass SpecialNeedle: pass"
    files["app/pkg.py"], files["mypkg.py"], files["pkg/__init__.py"], files["os.py"] = "no_more here", "UniqueTail", "", "SpecialNeedle2 again"
    chunks = [(f"{p}#{i}", p, part) for p, t in files.items() for i, part in enumerate((t[:len(t) // 2], t[len(t) // 2:]))]
    tasks = {1: "Where is SpecialNeedle used?", 2: "TreeBuilder and my_flask", 3: "nothing to find", 4: ""}
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    cs = spark.createDataFrame(chunks, "chunk string, path string, text string")
    ts = spark.createDataFrame(list(tasks.items()), "query long, text string")
    got = X.two_rounds(X.build_index(df, 8), cs, ts, df, imports=import_files, feedback_chunks=4).orderBy("query", "place").collect()
    want = []
    by_path = {}
    for c, p, t in chunks:
        by_path.setdefault(p, []).append((c, t))

    def of(keywords):
        out = []
        for k in naive_expand(keywords):
            for p in naive_grep(files, k):
                out += [x for x in sorted(by_path[p]) if x not in out]
        return out

    for q, t in tasks.items():
        one = of(naive_keywords(t))
        targets = set()
        for _, text in one:
            for line in text.split("\n"):
                m = re.match(r"from ([^ \t]*)|import ([^ \t,]*)", line.strip())
                top = ((m.group(1) or m.group(2) or "").rstrip(",").split(".")[0]) if m else ""
                if top not in ("", "import"):
                    targets |= {f"{top}.py", f"{top}/__init__.py"}
        two = sorted(x for p, xs in by_path.items() if any(p.endswith(g) for g in targets) for x in xs)
        two += of(naive_keywords("\n".join(x for _, x in one[:4]), 5))
        seen = list(dict.fromkeys([(c, 1) for c, _ in one] + [(c, 2) for c, _ in two if c not in {c for c, _ in one}]))
        want += [(q, c, r, i) for i, (c, r) in enumerate(seen, 1)]
    assert {r[2] for r in want} == {1, 2}
    assert [tuple(r) for r in got] == want


def test_index_odd(spark):
    empty = spark.createDataFrame([], "path string, text string")
    index = X.build_index(empty)
    assert index.count() == 0
    q = spark.createDataFrame([(1, "Parser"), (2, None)], "query long, keyword string")
    assert X.grep_index(index, q, files=empty).count() == 0
    long = spark.createDataFrame([("a", "word_ " * 50_000 + "Z" * 100_000)], "path string, text string")
    assert [r.path for r in X.grep_index(X.build_index(long), spark.createDataFrame([(1, "ord_"), (2, "Z" * 50)], "query long, keyword string")).collect()] == ["a", "a"]
