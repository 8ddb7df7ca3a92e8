"""Quality rules with distribution divergence, in DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import SPACES, materialize, words

#: Frequent function words of each language, as whole lower-case words.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "para"],
}
#: The list for texts of any other language, the leading words of the four.
POOLED = ["the", "of", "and", "to", "de", "la", "le", "et", "der", "die", "und", "in", "que", "el", "en", "y"]
OTHER = "*"
N_COMMON = 16

#: Characters that the base counts name symbols.
SYMBOLS = "[#*$%&|<>]"
#: Character classes of the histogram, each as the class of all that is not in it.
CLASSES = {"lower": r"[^\p{Ll}]+", "upper": r"[^\p{Lu}]+", "digit": r"[^\p{Nd}]+", "stop": r"[^.,;:!?]+", "symbol": "[^#*$%&|<>]+"}

#: A position takes the low bits of a packed window and its hash the rest.
POS_BITS = 24

MIN_WORDS = 50
MAX_REPEATED_PCT = 50
#: Guards: histograms of fewer characters or words than this say too little and reject nothing.
MIN_CHARS = 200
MIN_COMMON_WORDS = 100
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a text that stays.
MAX_CHAR_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.30


def base_counts(docs: DataFrame, text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row the base counts, the histograms and the language whose lists apply.

    Every count is an expression over the row's own array of words, so the pass
    needs no shuffle however long a text is. To find 3-word windows that occur
    twice, each window becomes one long (high bits of its XXH64, low bits its
    position), the longs are sorted, and neighbours with equal high bits are
    repeats. The words of such neighbours are compared; a row in which two
    different windows share the bits (or with over 2**24 words) is done again
    with the windows' strings, so the count is exact.
    """
    as_lang = F.when(F.col(lang).isin(*COMMON), F.col(lang)).otherwise(F.lit(OTHER)) if lang in docs.columns else F.lit(OTHER)
    listed = F.array(*map(F.lit, POOLED))
    for k, v in COMMON.items():
        listed = F.when(F.col("_lang") == k, F.array(*map(F.lit, v))).otherwise(listed)
    a = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias("_text"), as_lang.alias("_lang"), words(F.col(text)).alias("_w"))
    n = F.size("_w")
    low = (1 << POS_BITS) - 1
    firsts = F.slice("_w", 1, F.greatest(F.lit(0), n - 2))

    def win(x, i, f):
        return f(x, F.get(F.col("_w"), i + 1), F.get(F.col("_w"), i + 2))

    packed = F.sort_array(F.transform(firsts, lambda x, i: win(x, i, F.xxhash64).bitwiseAND(F.lit(~low & (1 << 63) - 1)).bitwiseOR(i.bitwiseAND(F.lit(low)).cast("long"))))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    frequent = F.filter("_w", lambda w: w.isin(*sorted({*POOLED, *sum(COMMON.values(), [])})))
    b = a.select(
        "*",
        n.cast("long").alias("n_words"),
        F.array_join("_w", "").alias("_chars"),
        packed.alias("_s"),
        lines.alias("_lines"),
        F.filter(F.transform(frequent, lambda w: F.array_position(listed, w)), lambda c: c > 0).alias("_codes"),
    )

    def alike(x, y):  # no long is negative, so neither is what two of them differ by
        return x.bitwiseXOR(y) <= F.lit(low)

    s = F.col("_s")
    b = b.select("*", F.regexp_replace("_chars", "[a-z]+", "").alias("_rest"), F.zip_with(F.slice(s, 1, F.greatest(F.lit(0), F.size(s) - 1)), F.slice(s, 2, 1 << 30), alike).alias("_same"))
    same = F.col("_same")
    c = b.select(
        "*",
        F.when(F.array_contains(same, True), F.filter(s, lambda x, i: F.get(same, i - 1) | F.get(same, i))).otherwise(F.array().cast("array<bigint>")).alias("_r"),
    )
    r = F.col("_r")

    def at(x):
        return x.bitwiseAND(F.lit(low)).cast("int")

    def differ(x, i):
        y = F.get(r, i - 1)
        p, q = at(x), at(y)
        w = F.col("_w")
        return (i > 0) & alike(x, y) & ((w[p] != w[q]) | (w[p + 1] != w[q + 1]) | (w[p + 2] != w[q + 2]))

    d = c.select("*", ((F.size(F.filter(r, differ)) > 0) | (F.col("n_words") > low)).alias("clash"))
    whole = F.sort_array(F.transform(firsts, lambda x, i: F.struct(win(x, i, lambda *v: F.concat_ws(" ", *v)).alias("s"), i.alias("i"))))
    e = d.select("*", F.when(F.col("clash"), whole).alias("_e"))
    es = F.col("_e")
    exact = F.transform(F.filter(es, lambda x, i: (x["s"] == F.get(es, i - 1)["s"]) | (x["s"] == F.get(es, i + 1)["s"])), lambda x: x["i"])
    g = e.select("*", F.sort_array(F.when(F.col("clash"), exact).otherwise(F.transform(r, at))).alias("_p"))
    p = F.col("_p")
    n_repeat = F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda t, x: t + x)
    chars = F.length("_chars").cast("long")
    counts = {k: F.length(F.regexp_replace("_rest", v, "")).cast("long") for k, v in CLASSES.items()}
    counts["lower"] += chars - F.length("_rest")
    return g.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
        F.col("_lang").alias("ref_lang"),
        "n_words",
        chars.alias("word_chars"),
        counts["symbol"].alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        n_repeat.cast("long").alias("n_repeat_words"),
        F.array(*counts.values()).alias("classes"),
        F.array(*[(F.size("_codes") - F.size(F.array_remove("_codes", F.lit(k)))).cast("long") for k in range(1, N_COMMON + 1)]).alias("commons"),
    )


def _with_rest(counts: Column, total: Column) -> Column:
    """The histogram closed by what no class counts."""
    return F.concat(counts, F.array(total - F.aggregate(counts, F.lit(0).cast("long"), lambda t, x: t + x)))


def _entropy(x: Column, m: Column) -> Column:
    return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance in base 2 of two arrays of shares: 0 for equal ones, 1 for disjoint ones."""
    parts = F.zip_with(p, q, lambda x, y: (_entropy(x, (x + y) / 2) + _entropy(y, (x + y) / 2)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)))


def quality_rules(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    keep: tuple[str, ...] = ("doc_id",),
    max_char_distance: float = MAX_CHAR_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
) -> DataFrame:
    """Judge every row by base counts and by divergence from its language's histograms.

    References are the pooled histograms of all rows of a language that pass the
    base rules (four languages and one for the rest, so five rows at most, which
    are broadcast). A text is rejected if it fails the base rules, or if its
    character classes or its common words lie farther than the limit from the
    reference and it is long enough (MIN_CHARS, MIN_COMMON_WORDS) to tell.

    Null and empty texts have no words and fail the base rules. Repeated rows are
    judged alike, each on its own. A null or unknown language has the pooled list.
    An empty table gives an empty result. Columns of docs that are not in `keep`
    are left out, so clashing names do no harm.
    """
    f = materialize(base_counts(docs, text, lang, keep), "quality")
    f = f.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words")),
        "_cls": _with_rest(F.col("classes"), F.col("word_chars")),
        "_com": _with_rest(F.col("commons"), F.col("n_words")),
    })
    sums = [F.sum(F.col("_cls")[i]).alias(f"c{i}") for i in range(len(CLASSES) + 1)] + [F.sum(F.col("_com")[i]).alias(f"w{i}") for i in range(N_COMMON + 1)]
    ref = f.where(~F.col("base_failed")).groupBy(F.col("ref_lang").alias("_ref")).agg(*sums)

    def shares(k, n):
        total = sum((F.col(f"{k}{i}") for i in range(n)), F.lit(0)).cast("double")
        return F.array(*[F.col(f"{k}{i}") / total for i in range(n)])

    ref = ref.select("_ref", shares("c", len(CLASSES) + 1).alias("_qc"), shares("w", N_COMMON + 1).alias("_qw"))

    def distance(x, q, total):
        return F.when((F.col(total) > 0) & F.col(q).isNotNull(), js_distance(F.transform(x, lambda v: v / F.col(total)), F.col(q))).otherwise(F.lit(0.0))

    out = f.join(F.broadcast(ref), f["ref_lang"] == ref["_ref"], "left").withColumns({
        "char_distance": distance("_cls", "_qc", "word_chars"),
        "word_distance": distance("_com", "_qw", "n_words"),
    })
    far = ((F.col("word_chars") >= MIN_CHARS) & (F.col("char_distance") > max_char_distance)) | ((F.col("n_words") >= MIN_COMMON_WORDS) & (F.col("word_distance") > max_word_distance))
    return out.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), *[F.round(c, 6).alias(c) for c in ("char_distance", "word_distance")])
