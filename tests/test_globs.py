"""Globs and ignore files against matching one path and rule at a time."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import globs as G


def match(p, s, crosses):
    """Whether glob p matches all of s; p is a list of tokens."""
    if not p:
        return not s
    t, rest = p[0], p[1:]
    if t == "**/":
        return match(rest, s, crosses) or any(s[i] == "/" and match(rest, s[i + 1:], crosses) for i in range(len(s)))
    if t == "/**":
        return s[:1] == "/" and len(s) > 1
    if t == "*":
        return match(rest, s, crosses) or bool(s) and (crosses or s[0] != "/") and match(p, s[1:], crosses)
    if not s:
        return False
    if t == "?":
        return (crosses or s[0] != "/") and match(rest, s[1:], crosses)
    if t[0] == "[" and len(t) > 1:
        inside = t[1:-1]
        no = inside[0] in "!^"
        return ((s[0] in inside[no:]) != no) and match(rest, s[1:], crosses)
    return s[0] == t[-1] and match(rest, s[1:], crosses)


def tokens(p, crosses):
    out, i = [], 0
    while i < len(p):
        if not crosses and p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out.append("**/")
            i += 3
        elif not crosses and p[i:] == "/**":
            out.append("/**")
            i += 3
        elif p[i] == "*":
            out.append("*")
            i += 1
        elif p[i] == "[" and "]" in p[i + 2:]:
            j = p.index("]", i + 2)
            out.append(p[i:j + 1])
            i = j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            out.append(p[i:i + 2])
            i += 2
        else:
            out.append(p[i])
            i += 1
    return out


def naive_hidden(path, ignore, names):
    parts = path.split("/")
    for n in range(1, len(parts) + 1):
        entry, is_folder, verdict = parts[:n], n < len(parts), None
        for name in names:
            for depth in range(n):
                for line in ignore.get(("/".join(parts[:depth]), name), "").split("\n"):
                    rule = line.rstrip()
                    if not rule or rule[0] == "#":
                        continue
                    keeps = rule[0] == "!"
                    rule = rule[keeps:]
                    only = rule.endswith("/")
                    rule = rule.rstrip("/")
                    if not rule or only and not is_folder:
                        continue
                    glob = rule.removeprefix("/") if "/" in rule else f"**/{rule}"
                    if match(tokens(glob, False), "/".join(entry[depth:]), False):
                        verdict = keeps
        if verdict is False:
            return True
    return False


RULES = ["*.log", "!keep.log", "build/", "/a", "a/b", "a/**", "**/c", "b/**/d.txt", "d?.txt", "[ab].md", "[!a].md", "!*/", "*.*", "# note", "", "  ", "!b/d.txt", "x.y", r"\#odd", r"\!b", "a*/", "!a/", "c/**", "c/*", "(+)"]
NAMES = ["a", "b", "c", "build", "ab"]
ENDS = ["x.log", "keep.log", "d.txt", "d1.txt", "a.md", "c.md", "x.y", "xzy", "#odd", "!b", "(+)", "abc"]


def test_ignore_files(spark):
    rng = random.Random(4)
    names = (".gitignore", ".ignore")
    for round_ in range(3):
        paths = sorted({"/".join([*rng.choices(NAMES, k=rng.randint(0, 3)), rng.choice(ENDS)]) for _ in range(250)})
        folders = ["", *{"/".join(p.split("/")[:-1]) for p in paths}]
        ignore = {(f, rng.choice(names)): "\n".join(rng.choices(RULES, k=rng.randint(0, 4))) for f in rng.sample(folders, min(len(folders), 12)) + [""]}
        files = spark.createDataFrame([(p, i) for i, p in enumerate([*paths, paths[0]])] + [(None, 0)], "path string, entry int")
        table = spark.createDataFrame([(f, n, t, "x") for (f, n), t in ignore.items()] + [("", "other", "*", "x"), (None, ".gitignore", "", "x")], "folder string, name string, text string, line string")
        got = sorted(r.path for r in G.not_ignored(files, table, names).collect())
        want = sorted(p for p in [*paths, paths[0]] if not naive_hidden(p, ignore, names))
        assert 0 < len(want) < len(paths), round_
        assert got == want


def test_globs(spark):
    paths = ["a.rs", "src/a.rs", "src/b/a.py", "src/b.txt", "x{y", "a.{b", "a+b", "[z", "src/[z", "a?b", "ünï.rs"]
    df = spark.createDataFrame([(p,) for p in [*paths, None]], "path string")
    for p in ["*.rs", "src/*", "src/?.txt", "*.{rs,py}", "{src,x}/{a,b}*", "x{y", "a.{b", "a+b", "[z", "[a-z].rs", "a\\?b", "**/*.py", "", "*[!s]", "{a,}.rs"]:
        want = {x for x in paths if any(match(tokens(q.replace("**", "*"), True), x, True) if "[a-z]" not in q else __import__("re").fullmatch("[a-z]\\.rs", x) for q in G.expand_braces(p))}
        assert {r.path for r in df.where(G.matches_glob(F.col("path"), p)).collect()} == want, p
    assert G.expand_braces("a{b,c}d{e,f}") == ["abde", "abdf", "acde", "acdf"] and G.expand_braces("a}{b") == ["a}{b"]
    assert {r.path for r in df.where(G.matches_filters(F.col("path"), "src/*", "rs")).collect()} == {"src/a.rs"}
    none = spark.createDataFrame([], "folder string, name string, text string")
    assert [r.path for r in G.glob_files(df, none, "*", "src", 1).orderBy("path").collect()] == ["src/[z", "src/a.rs", "src/b.txt"]
    assert [r.path for r in G.glob_files(df, none, "*.rs", max_paths=2).collect()] == ["a.rs", "src/a.rs"]
    assert G.glob_files(df.limit(0), none, "*").count() == 0
    with pytest.raises(ValueError):
        G.glob_files(df, none, "../*")
