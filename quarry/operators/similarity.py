"""Similar messages by tools, files and length: an exact set-similarity join, and leader clusters in rounds.

Two messages of a scope and role have the similarity 0.4 * jaccard(tools) + 0.4 *
jaccard(files) + 0.2 * (lesser length / larger length); two empty sets are alike, an empty
and another one are not, and two lengths of 0 have the ratio 1.

Messages of one scope, role, tools and files make a class. Any two of a class have 0.8 or
more, and whether messages of two classes are similar depends on their lengths alone: a link
of classes has the least ratio of lengths that suffices. So neither the join nor the clusters
expand the pairs of messages that are alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators.common import written

_TOOLS, _FILES, _LENGTH = 0.4, 0.4, 0.2
#: Sums of weights are compared with this much room for rounding.
_EPS = 1e-9


def message_classes(messages: DataFrame) -> DataFrame:
    """messages (scope, turn, role, tools, files, length) with `id`, unique and in the order of turns, and `class`.

    Sets may hold nulls and repeats, which don't count; a null set is empty, a null length 0.
    System messages are left out. Rows that repeat a turn come in an order of their own.
    """
    m = messages.where("role is null or role <> 'system'").select("scope", "turn", "role", *[F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>"))))).alias(c) for c in ("tools", "files")], F.coalesce("length", F.lit(0)).cast("long").alias("length"))
    m = m.withColumn("id", F.struct("turn", F.monotonically_increasing_id().alias("tie")))
    return written(m.withColumn("class", F.md5(F.to_json(F.struct("scope", "role", "tools", "files")))), "messages")


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def class_links(messages: DataFrame, similarity: float = 0.6) -> DataFrame:
    """(a, b, ratio): classes a < b whose messages are similar where their lengths have at least that ratio; such lengths occur.

    messages: as `message_classes` gives them. Candidates of 0.4 * t + 0.4 * f + 0.2 * r >=
    similarity share a file among their rarest (f at least half of what is needed), or one of
    the rarest tools and any file (t at least half), or tools that suffice alone. Tokens are
    ordered by how many classes hold them; a set of n tokens that must share a part p shows
    its n - ceil(p * n) + 1 rarest, and sets whose sizes rule the part out aren't compared.
    """
    if not _LENGTH < similarity <= _TOOLS + _FILES:
        raise ValueError("similarity must lie above 0.2, and at 0.8 or below: beyond that a class is no longer alike")
    need = (similarity - _LENGTH) / _TOOLS  # jaccard(tools) + jaccard(files) is at least this
    c = messages.groupBy("class").agg(*[F.first(x).alias(x) for x in ("scope", "role", "tools", "files")], F.min("length").alias("low"), F.max("length").alias("high"))
    for x in ("tools", "files"):  # an empty set is alike to an empty one alone
        c = c.withColumn(x, F.when(F.size(x) == 0, F.array(F.lit(""))).otherwise(F.transform(x, lambda t: F.concat(F.lit("="), t))))
    c = written(c.withColumn("room", F.xxhash64("scope", "role")), "classes")

    def prefix(kind: str, part: float) -> DataFrame:
        """(class, token): the rarest tokens of a set, enough for any set that shares `part` of it."""
        each = c.select("class", "room", F.explode(kind).alias("token"), F.size(kind).alias("n"))
        rare = each.join(each.groupBy("room", "token").agg(F.count("*").alias("held")), ["room", "token"])
        order = rare.groupBy("class", "room", "n").agg(F.sort_array(F.collect_list(F.struct("held", "token"))).alias("ts"))
        shown = F.col("n") - F.ceil(F.col("n") * part - _EPS).cast("int") + 1
        return order.select("class", "room", "n", F.explode(F.slice("ts", F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), shown)))).alias("t")).select("class", "room", "n", "t.token")

    def pairs(keys: DataFrame, on: list[str], part: float) -> DataFrame:
        a, b = (keys.select(*on, F.col("class").alias(x), F.col("n").alias(f"n_{x}")) for x in ("a", "b"))
        sizes = F.least("n_a", "n_b") >= part * F.greatest("n_a", "n_b") - _EPS
        return a.join(b, on).where((F.col("a") < F.col("b")) & sizes).select("a", "b")

    files, tools = prefix("files", need / 2), prefix("tools", need / 2)
    both = tools.join(c.select("class", F.explode("files").alias("file")), "class")
    found = pairs(files, ["room", "token"], need / 2).unionByName(pairs(both, ["room", "token", "file"], need / 2))
    if need <= 1:  # tools that suffice without a file: only where lengths that are near enough occur
        least = max(0.0, (similarity - _TOOLS) / _LENGTH)
        alone = prefix("tools", need).join(messages.select("class", "length").distinct(), "class")
        if least >= 1 - _EPS:
            alone = alone.withColumn("band", F.array(F.col("length").cast("double")))
        elif least > 0:  # lengths of that ratio lie in the same band or the next
            band = F.floor(F.log(F.col("length") + F.lit(0.0)) / (-F.log(F.lit(least)) * (1 + 1e-6)))
            alone = alone.withColumn("band", F.when(F.col("length") == 0, F.array(F.lit(-1.0))).otherwise(F.array(band.cast("double"), band.cast("double") + 1)))
        else:
            alone = alone.withColumn("band", F.array(F.lit(0.0)))
        alone = alone.select("class", "room", "n", "token", F.explode("band").alias("band")).distinct()
        found = found.unionByName(pairs(alone, ["room", "token", "band"], need))
    found = found.distinct()
    x, y = (c.select(F.col("class").alias(s), *[F.col(k).alias(f"{k}_{s}") for k in ("room", "scope", "role", "tools", "files", "low", "high")]) for s in ("a", "b"))
    j = found.join(x, "a").join(y, "b").where(F.col("scope_a").eqNullSafe(F.col("scope_b")) & F.col("role_a").eqNullSafe(F.col("role_b")))
    sets = _TOOLS * _jaccard(F.col("tools_a"), F.col("tools_b")) + _FILES * _jaccard(F.col("files_a"), F.col("files_b"))
    j = j.withColumn("ratio", F.greatest(F.lit(0.0), (similarity - sets) / _LENGTH))
    apart = F.least("high_a", "high_b") < F.greatest("low_a", "low_b")
    near = F.when(apart, F.least("high_a", "high_b") / F.greatest("low_a", "low_b")).otherwise(1.0)  # no two lengths are nearer
    return j.where((F.col("ratio") <= 1 + _EPS) & (near >= F.col("ratio") - _EPS)).select("a", "b", "ratio")


def length_ratio(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), 1.0).otherwise(F.least(a, b) / F.greatest(a, b))


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b", "ratio").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "ratio"))


def link_counts(messages: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class, n_links): to how many other messages each is similar.

    messages: as `message_classes` gives them; links: as `class_links` does. Lengths are counted by
    value and class, so no pair of messages is made.
    """
    size = messages.groupBy("class").agg(F.count("*").alias("size"))
    lengths = messages.groupBy("class", "length").agg(F.count("*").alias("n"))
    a, b = lengths.select(F.col("class").alias("a"), F.col("length").alias("l")), lengths.select(F.col("class").alias("b"), F.col("length").alias("m"), "n")
    far = _both_ways(links).join(a, "a").join(b, "b").where(length_ratio(F.col("l"), F.col("m")) >= F.col("ratio") - _EPS)
    far = far.groupBy(F.col("a").alias("class"), F.col("l").alias("length")).agg(F.sum("n").alias("others"))
    found = messages.join(size, "class").join(far, ["class", "length"], "left")
    return found.select("id", "class", "scope", "turn", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))


def leader_clusters(messages: DataFrame, links: DataFrame, least: int = 3) -> DataFrame:
    """(id, class, scope, turn, leader): in the order of turns, a message without a cluster gathers all later ones without one that are similar to it.

    A group of fewer than `least` is not made, and its first message stays without a cluster
    (a null leader). messages and links as above. A message is decided once it comes first
    among the classes linked to its own and those linked to them, which nothing earlier can
    change; so each round decides many, and a class goes as soon as a leader of its own is found.
    """
    spark = messages.sparkSession
    m = written(messages.select("id", "class", "scope", "turn", "length"), "members")
    near = written(_both_ways(links).unionByName(m.select(F.col("class").alias("a"), F.col("class").alias("b"), F.lit(0.0).alias("ratio")).distinct()), "near")
    left, done = m.select("id", "class", "length"), []
    while not left.isEmpty():
        first = left.groupBy("class").agg(F.min(F.struct("id", "length")).alias("f")).select("class", "f.id", "f.length")
        around = near.join(first.select(F.col("class").alias("b"), F.col("id").alias("i")), "b").groupBy("a").agg(F.min("i").alias("i"))
        around = near.join(around.select(F.col("a").alias("b"), "i"), "b").groupBy("a").agg(F.min("i").alias("i"))
        heads = first.join(around.withColumnRenamed("a", "class"), "class").where("id = i").select(F.col("class").alias("a"), F.col("id").alias("leader"), F.col("length").alias("l"))
        reach = near.join(heads, "a").select(F.col("b").alias("class"), "ratio", "leader", "l")
        got = written(left.join(reach, "class").where((F.col("id") >= F.col("leader")) & ((F.col("id") == F.col("leader")) | (length_ratio(F.col("length"), F.col("l")) >= F.col("ratio") - _EPS))).select("id", "leader"), "reached")
        sizes = got.groupBy("leader").agg(F.count("*").alias("n"))
        got = got.join(sizes, "leader").where((F.col("n") >= least) | (F.col("id") == F.col("leader")))
        got = written(got.select("id", F.when(F.col("n") >= least, F.col("leader")).alias("leader")), "decided")
        done.append(got)
        left = written(left.join(got.select("id"), "id", "left_anti"), "left")
    decided = spark.createDataFrame([], m.select("id", F.col("id").alias("leader")).schema) if not done else done[0]
    for d in done[1:]:
        decided = decided.unionByName(d)
    return m.join(decided, "id").select("id", "class", "scope", "turn", "leader")
