"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join.

A word of l code points is cut into two segments of l // 2 and l - l // 2. One edit touches
one segment at most, so the other stands unchanged in any near word of equal or one more
code point: the first at its start, the second, shifted by the difference in length, at its
end. Every word is indexed under its two segments and probes those of its own length and of
one less. Candidates that share a segment are verified by one edit; those that share both
are taken from the first alone, so no pair comes twice.

Segments that many words share are split: what is left of two such words must be one edit
apart too, so the same cut of the rest gives keys that are longer by half of it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import materialize, slices

#: Maximal runs of letters; the lower-casing of A-Z is done before.
_RUN = r"[a-zÀ-ÿ]"
#: Distinct words that a task counts before it hands them on.
HELD = 200_000
#: Words that share a segment before it is split.
BUCKET = 256
#: Characters from which a text's runs are not listed at once.
LONG = 4 << 20


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", drop_every: int = 97, min_length: int = 5) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z in lower case, of at least min_length code points.

    Where drop_every divides h, the unsigned CRC-32 of `<key>:<run>`, the run loses its code
    point h % length (0: none does). Null texts have no runs, a null key reads as empty, and
    rows that repeat a key are counted each. Other columns are left out.
    """
    source = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).cast("string").alias("text"))
    run = re.compile(f"{_RUN}{{{min_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in slices(batch, 1):
                for k, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if not t:
                        continue
                    low = t.lower().decode("utf-8", "replace")  # lower() of bytes changes A-Z alone
                    found = run.findall(low) if len(low) < LONG else (m.group() for m in run.finditer(low))
                    start = zlib.crc32(f"{k}:".encode())
                    for w, n in Counter(found).items():
                        if drop_every and (h := zlib.crc32(w.encode(), start)) % drop_every == 0:
                            at = h % len(w)
                            w = w[:at] + w[at + 1:]
                            if len(w) < min_length:
                                continue
                        total[w] += n
                if len(total) >= HELD:
                    yield flush()
        if total:
            yield flush()

    return source.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _halves(word: Column, length: Column) -> Column:
    """The segments of words of `length` code points: (1, start), (2, end)."""
    half = F.floor(length / 2).cast("int")
    return F.array(
        F.struct(F.lit(1).alias("seg"), F.substring(word, F.lit(1), half).alias("piece")),
        F.struct(F.lit(2).alias("seg"), F.substring(word, F.length(word) - (length - half) + 1, length - half).alias("piece")),
    )


def _start(word: Column, length: Column) -> Column:
    return F.substring(word, F.lit(1), F.floor(length / 2).cast("int"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): all pairs of distinct words of the column `word` that one inserted, deleted or replaced code point parts, both ways round.

    Nulls and the empty word have no pairs, and words that repeat count once. words is read several times.
    """
    w = words.where("word is not null and word <> ''").select("word").distinct().withColumn("length", F.length("word"))

    def keyed(lengths: Column) -> DataFrame:
        """A row for each segment under which a word is indexed or probes."""
        x = w.select("word", F.explode(lengths).alias("len")).where("len > 0")
        x = x.select("word", "len", F.inline(_halves(F.col("word"), F.col("len"))))
        size = F.length("piece")
        rest = F.when(F.col("seg") == 1, F.substring(F.col("word"), size + 1, F.length("word"))).otherwise(F.substring(F.col("word"), F.lit(1), F.length("word") - size))
        return x.withColumn("rest", rest)

    index, probe = keyed(F.array(F.col("length"))), keyed(F.array(F.col("length"), F.col("length") - 1))
    key = ["len", "seg", "piece"]
    hot = index.groupBy(*key).count().where(F.col("count") > BUCKET).select(*key, F.lit(True).alias("hot"))

    def split(x: DataFrame) -> DataFrame:
        whole = F.array(F.struct(F.lit(0).alias("seg"), F.lit("").alias("piece")))
        at = F.when(F.col("hot"), _halves(F.col("rest"), F.col("len") - F.length("piece"))).otherwise(whole)
        return x.join(hot, key, "left").withColumn("sub", F.explode(at)).drop("hot")

    a = split(probe).select(*key, "sub", F.col("word").alias("a"), F.col("rest").alias("rest_a"))
    b = split(index).select(*key, "sub", F.col("word").alias("b"), F.col("rest").alias("rest_b"))
    size, left = F.col("len"), F.col("len") - F.length("piece")
    once = (F.col("seg") == 1) | (_start(F.col("a"), size) != _start(F.col("b"), size))
    once_below = (F.col("sub.seg") != 2) | (_start(F.col("rest_a"), left) != _start(F.col("rest_b"), left))
    first = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))  # words of equal length meet twice
    found = a.join(b, [*key, "sub"]).where(first & once & once_below & (F.levenshtein("a", "b", 1) == 1)).select("a", "b")
    return found.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near")), F.struct(F.col("b").alias("word"), F.col("a").alias("near")))))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form) without cycles: each round doubles the steps that a word has gone."""
    up = materialize(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(up.join(over, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        up = step.select("word", "root")
        if step.where("moved").isEmpty():
            return up


def spelling_variants(words: DataFrame, least_ratio: int = 2) -> DataFrame:
    """Group the words of (word, n) into spelling variants of a commoner word.

    near: words that one edit parts. form: the near word of largest n, the smallest in
    code-point order among equals, if its n is at least least_ratio (2 or more) times the
    word's own; else null. root: the last word that forms lead to. Returns (word, form, root,
    n, n_near, form_n), a row for each word. An empty table gives an empty one; a null word
    is left out, and of a word that repeats the counts are added.
    """
    if least_ratio < 2:
        raise ValueError("forms lead round in circles unless a form is commoner than its word")
    words = materialize(words.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    pairs = near_pairs(words).join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    top, top_n = F.col("best.near"), -F.col("best.minus")
    good = top_n >= least_ratio * F.col("n")
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast(T.LongType()).alias("n_near"),
        F.when(good, top).alias("form"), F.when(good, top_n).alias("form_n"),
    )
    found = materialize(found, "variants")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
