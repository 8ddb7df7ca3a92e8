"""Keyword search over an inverted index: terms with blocks of paths, probed by a batch of queries, in two rounds.

A term is a maximal run of the letters, digits and underscores that keywords are made of, so a
text contains a keyword just where one of its terms does. Keywords meet the vocabulary, not
the texts: through the rarest of their runs of three characters, then by the whole keyword.
A term's paths lie in blocks, so a term that every file holds is many rows of bounded size.
"""

from __future__ import annotations

import re
from array import array
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.expansions import DOMAIN_TERMS, SYNONYMS
from quarry.operators.common import written

TERM = "[A-Za-z0-9_]+"
_TERM = re.compile(TERM)
KEYWORD = "[A-Za-z_][A-Za-z0-9_]+"
#: Files of a posting block, at most.
BLOCK = 1024
GRAM = 3
#: A text's bytes with a blank for what no term has.
_APART = bytes(c if _TERM.match(chr(c)) and c < 128 else 32 for c in range(256))
#: Terms that a scan keeps in memory, at most.
KEPT_TERMS = 1 << 20


def _segments(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    """Batches (term, block, paths) of batches (path, text): the postings of `block` files at a time."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        for start in range(0, batch.num_rows, block):
            part = batch.slice(start, block)
            part = part.take(pc.sort_indices(part.column("path")))
            paths, held, first = part.column("path"), {}, 0
            names = paths.to_pylist()
            for i, text in enumerate(part.column("text").to_pylist()):
                first = i if names[i] != names[first] else first
                for term in set(_TERM.findall(text or "")):
                    at = held.setdefault(term, array("i"))
                    if not at or at[-1] != first:
                        at.append(first)
            ends = np.cumsum([0] + [len(at) for at in held.values()], dtype=np.int32)
            flat = np.concatenate([np.frombuffer(at, dtype=np.int32) for at in held.values()]) if held else np.array([], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), paths.take(pa.array(flat)))
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(np.full(len(held), number)), lists], ["term", "block", "paths"])
            number += 1


def build_index(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """Postings of files (path, text): (term, block, paths), paths in order, each once in a term's block; a block is of `block` files at most.

    Blocks are made where the files are read, so no postings are shuffled. A null text or path holds no term. Write the
    result once, and probe it with `grep_index`.
    """
    kind = files.schema["path"].dataType.simpleString()
    return files.where("path is not null").select("path", "text").mapInArrow(lambda batches: _segments(batches, block), f"term string, block long, paths array<{kind}>")


def _grams(word: Column) -> Column:
    """The runs of one, two and three characters of a word."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(GRAM), F.length(word))), lambda n: F.transform(F.sequence(F.lit(1), F.length(word) - n + 1), lambda i: F.substring(word, i, n)))))


def match_terms(index: DataFrame, keywords: DataFrame) -> DataFrame:
    """(keyword, term): the index's terms that contain a keyword (keyword), letters' case as it is.

    A keyword that isn't made of a term's characters matches nothing here.
    """
    k = keywords.where(F.col("keyword").rlike(f"^{TERM}$")).select("keyword").distinct()
    own = k.select("keyword", F.explode(_grams(F.col("keyword"))).alias("gram")).where(F.length("gram") == F.least(F.lit(GRAM), F.length("keyword")))
    terms = index.select("term").distinct()
    held = terms.select("term", F.explode(_grams(F.col("term"))).alias("gram")).join(own.select("gram").distinct(), "gram", "left_semi")
    rare = own.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram")).alias("g"), F.count("*").alias("found"))
    size = F.greatest(F.lit(1), F.length("keyword") - GRAM + 1)
    whole = own.groupBy("keyword").agg(F.count("*").alias("need")).join(rare, "keyword").where("found = need").select("keyword", F.col("g.gram").alias("gram")).where(size > 0)
    return held.join(whole, "gram").where(F.contains("term", F.col("keyword"))).select("keyword", "term")


def grep_index(index: DataFrame, queries: DataFrame, top: int = 5, files: DataFrame | None = None) -> DataFrame:
    """(query, keyword, path, place): for each query's keyword (query, keyword) the first `top` paths, in order, of files that contain it.

    A keyword with other characters than a term's, such as a blank, is looked up by its longest
    run of those and then held against the texts of `files` (path, text) found; without
    `files`, or without such a run, it matches nothing. An empty keyword matches nothing.
    """
    # Terms found are written first: as a table of known size they meet the index by a broadcast wherever they are few.
    found = written(match_terms(index, queries), "terms").join(index, "term").select("keyword", F.explode(F.slice("paths", 1, top)).alias("path")).distinct()
    if files is not None:
        odd = queries.where(~F.col("keyword").rlike(f"^{TERM}$")).select(F.col("keyword").alias("whole")).distinct()
        longest = F.array_max(F.transform(F.regexp_extract_all("whole", F.lit(TERM), F.lit(0)), lambda x: F.struct(F.length(x).alias("n"), x.alias("run"))))
        odd = odd.select("whole", longest["run"].alias("keyword")).where("keyword is not null")
        held = written(match_terms(index, odd), "terms").join(odd, "keyword").join(index, "term").select("whole", F.explode("paths").alias("path")).distinct()
        held = held.join(files.select("path", "text"), "path").where(F.contains("text", F.col("whole"))).select(F.col("whole").alias("keyword"), "path")
        found = found.unionByName(held.distinct())
    place = F.row_number().over(W.partitionBy("keyword").orderBy("path"))
    first = found.withColumn("place", place).where(F.col("place") <= top)
    return queries.select("query", "keyword").distinct().join(first, "keyword").select("query", "keyword", "path", "place")


def _first_paths(batches: Iterator[pa.RecordBatch], keywords: list[str], top: int) -> Iterator[pa.RecordBatch]:
    """(keyword, path) of batches (path, text): each keyword's first `top` paths of this task."""
    plain = {w.encode() for w in keywords if _TERM.fullmatch(w)}
    short, begin, odd = [w for w in plain if len(w) < GRAM], {}, [w.encode() for w in keywords if w and not _TERM.fullmatch(w)]
    for w in plain:
        if len(w) >= GRAM:
            begin.setdefault(w[:GRAM], []).append(w)
    first = {w: [] for w in (*plain, *odd)}
    without, matched, kind = set(), {}, None

    def words(term):
        found = {w for i in range(len(term) - GRAM + 1) for w in begin.get(term[i:i + GRAM], ()) if term.startswith(w, i)}
        return found.union(w for w in short if w in term)

    for batch in batches:
        kind = batch.schema.field("path").type
        for path, text in zip(batch.column("path").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            hit = set()
            for term in set((text or b"").translate(_APART).split()) - without:
                found = matched.get(term)
                if found is None:
                    found = words(term)
                    if not found:
                        without.add(term)
                        continue
                    matched[term] = found
                hit |= found
            hit.update(w for w in odd if text and (len(first[w]) < top or path < first[w][-1]) and w in text)
            for w in hit:
                held = first[w]
                if (len(held) < top or path < held[-1]) and path not in held:
                    insort(held, path)
                    del held[top:]
            if len(without) + len(matched) > KEPT_TERMS:
                without.clear()
                matched.clear()
    if kind is not None:
        rows = [(w.decode(), path) for w, held in first.items() for path in held]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in rows], pa.string()), pa.array([path for _, path in rows], kind)], ["keyword", "path"])


def grep_files(files: DataFrame, queries: DataFrame, top: int = 5) -> DataFrame:
    """(query, keyword, path, place) as of `grep_index`, from one pass over the texts of files (path, text) and no index.

    For a batch of queries that is asked once: the keywords go to every task, and a task keeps `top` paths of each.
    """
    words = [r["keyword"] for r in queries.select("keyword").where("keyword is not null").distinct().collect()]
    kind = files.schema["path"].dataType.simpleString()
    found = files.where("path is not null").select("path", "text").mapInArrow(lambda batches: _first_paths(batches, words, top), f"keyword string, path {kind}").distinct()
    first = found.withColumn("place", F.row_number().over(W.partitionBy("keyword").orderBy("path"))).where(F.col("place") <= top)
    return queries.select("query", "keyword").distinct().join(first, "keyword").select("query", "keyword", "path", "place")


def extract_keywords(texts: DataFrame, limit: int = 8, least: int = 3) -> DataFrame:
    """(query, pos, keyword) of (query, text): identifiers with a capital or an underscore, longest first (of equals as they come), neighbours that repeat once, `limit` at most."""
    k = texts.select("query", F.posexplode(F.regexp_extract_all("text", F.lit(KEYWORD), F.lit(0))).alias("at", "keyword")).where((F.length("keyword") >= least) & F.col("keyword").rlike("[A-Z_]"))
    w = W.partitionBy("query").orderBy(F.desc(F.length("keyword")), "at")
    k = k.withColumn("before", F.lag("keyword").over(w)).where(~F.col("keyword").eqNullSafe(F.col("before")))
    return k.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= limit).select("query", "pos", "keyword")


def expand_keywords(keywords: DataFrame, limit: int = 20) -> DataFrame:
    """(query, pos, keyword): keywords (query, pos, keyword) with the terms of frameworks they name and their synonyms, each once whatever its case.

    After a keyword come its framework terms (frameworks in alphabetical order) and its
    synonyms. The list ends with the framework term, or else with the keyword, at which it holds `limit`.
    """
    spark = keywords.sparkSession
    domains = spark.createDataFrame([(name, i * 100 + j, t) for i, (name, ts) in enumerate(sorted(DOMAIN_TERMS.items())) for j, t in enumerate(ts)], "name string, ordinal int, term string")
    pairs = [(a, i, b) for i, (a, b) in enumerate(SYNONYMS)] + [(b, i, a) for i, (a, b) in enumerate(SYNONYMS)]
    synonyms = spark.createDataFrame(pairs, "name string, ordinal int, term string")
    k = keywords.withColumn("lower", F.lower("keyword"))
    own = k.select("query", "pos", F.lit(0).alias("kind"), F.lit(0).alias("ordinal"), "keyword")
    terms = k.join(F.broadcast(domains), F.contains("lower", F.col("name"))).select("query", "pos", F.lit(1).alias("kind"), "ordinal", F.col("term").alias("keyword"))
    alike = k.join(F.broadcast(synonyms), F.col("lower") == F.col("name")).select("query", "pos", F.lit(2).alias("kind"), "ordinal", F.col("term").alias("keyword"))
    order = ["pos", "kind", "ordinal"]
    first = F.row_number().over(W.partitionBy("query", F.lower("keyword")).orderBy(*order))
    x = own.unionByName(terms).unionByName(alike).withColumn("nth", first).where("nth = 1")
    w = W.partitionBy("query").orderBy(*order)
    x = x.withColumn("rank", F.row_number().over(w))
    full = F.min(F.when(F.col("rank") == limit, F.col("pos"))).over(W.partitionBy("query"))
    late = F.max(F.when((F.col("rank") >= limit) & (F.col("kind") == 1), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, -1))
    x = x.withColumn("full", full).withColumn("late", F.coalesce(late, F.lit(0)))
    kept = (F.col("rank") <= limit) | ((F.col("pos") == F.col("full")) & (F.col("late") == 0))
    return x.where(kept).select("query", F.col("rank").alias("pos"), "keyword")


def keyword_candidates(index: DataFrame, chunks: DataFrame, keywords: DataFrame, top: int = 5, files: DataFrame | None = None) -> DataFrame:
    """(query, chunk, pos): chunks (chunk, path) of the first `top` files of each keyword (query, pos, keyword), in the order of keywords, files and chunks."""
    keywords = written(keywords, "keywords")
    return hit_candidates(chunks, keywords, grep_index(index, keywords, top, files))


def hit_candidates(chunks: DataFrame, keywords: DataFrame, found: DataFrame) -> DataFrame:
    """(query, chunk, pos) as of `keyword_candidates`, of keywords (query, pos, keyword) and what was found for them (query, keyword, path, place)."""
    hits = keywords.join(found, ["query", "keyword"]).select("query", "path", F.struct(F.col("pos").alias("keyword"), "place").alias("hit"))
    hits = written(hits.groupBy("query", "path").agg(F.min("hit").alias("hit")), "keyword-files")  # a table of known size: it is sent to the chunks
    return hits.join(chunks.select("chunk", "path"), "path").select("query", "chunk", F.struct("hit.keyword", "hit.place", "chunk").alias("pos"))


def import_candidates(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """(query, chunk): chunks (chunk, path) whose path ends in a target (query, target).

    Targets meet paths by their last characters, 12 at most, then as a whole.
    """
    t = targets.where("target <> ''").withColumn("n", F.least(F.lit(12), F.length("target"))).withColumn("tail", F.expr("right(target, n)"))
    p = chunks.select("path").distinct().select("path", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n")).where(F.length("path") >= F.col("n")).withColumn("tail", F.expr("right(path, n)"))
    p = p.join(t.select("n").distinct(), "n", "left_semi")
    found = t.join(p, ["n", "tail"]).where(F.endswith("path", F.col("target"))).select("query", "path").distinct()
    return found.join(chunks.select("chunk", "path"), "path").select("query", "chunk")


def two_rounds(index: DataFrame, chunks: DataFrame, tasks: DataFrame, files: DataFrame | None = None, first: DataFrame | None = None, imports: Callable[[Column], Column] | None = None, top: int = 5, feedback_chunks: int = 10, feedback_keywords: int = 5) -> DataFrame:
    """(query, chunk, round, place): candidates of a batch of tasks (query, text) in two rounds.

    Round 1 is `first` (query, chunk, pos), such as the nearest chunks, and then the files of a task's
    expanded keywords. The texts of its first `feedback_chunks` chunks give further keywords,
    and those of all its chunks the import targets (`imports` maps a text to an array of them);
    round 2 adds the chunks that imports name and then those of the keywords' files. A chunk
    comes once, where it came first; place numbers a query's chunks from 1.

    index as of `build_index` over `files`; chunks (chunk, path, text). A task without keywords has only
    what `first` gives it.
    """
    one = keyword_candidates(index, chunks, expand_keywords(extract_keywords(tasks)), top, files).select("query", "chunk", F.lit(1).alias("source"), "pos")
    empty = F.struct(F.lit(0).alias("keyword"), F.lit(0).alias("place"), F.lit(None).cast(chunks.schema["chunk"].dataType).alias("chunk"))
    if first is not None:
        own = first.select("query", "chunk", F.lit(0).alias("source"), F.struct(F.lit(0).alias("keyword"), F.col("pos").cast("int").alias("place"), "chunk").alias("pos"))
        one = own.unionByName(one)
    one = one.groupBy("query", "chunk").agg(F.min(F.struct("source", "pos")).alias("at"))
    one = written(one.withColumn("nth", F.row_number().over(W.partitionBy("query").orderBy("at", "chunk"))), "round-one")
    texts = one.join(chunks.select("chunk", "text"), "chunk")
    fed = texts.where(F.col("nth") <= feedback_chunks).groupBy("query").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n").alias("text"))
    more = keyword_candidates(index, chunks, expand_keywords(extract_keywords(fed, feedback_keywords, 3)), top, files).select("query", "chunk", F.lit(3).alias("source"), "pos")
    if imports is not None:
        targets = texts.select("query", F.explode(imports(F.col("text"))).alias("target")).distinct()
        more = import_candidates(chunks, targets).select("query", "chunk", F.lit(2).alias("source"), empty.alias("pos")).unionByName(more)
    two = more.groupBy("query", "chunk").agg(F.min(F.struct("source", "pos")).alias("at")).join(one.select("query", "chunk"), ["query", "chunk"], "left_anti")
    both = one.select("query", "chunk", F.lit(1).alias("round"), "at").unionByName(two.select("query", "chunk", F.lit(2).alias("round"), "at"))
    return both.select("query", "chunk", "round", F.row_number().over(W.partitionBy("query").orderBy("round", "at", "chunk")).alias("place"))
