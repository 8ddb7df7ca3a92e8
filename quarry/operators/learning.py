"""Edge learning: Beta posteriors of co-accessed pairs, group-relative advantages and clipped updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ETA, ALPHA, BETA = 0.1, 0.5, 1.5


def coaccess_pairs(access: DataFrame) -> DataFrame:
    """Unordered pairs of distinct items of a session, a session's size with each: (session, ok, a, b, n). access: (session, item, ok).

    A session's distinct items come together once, as an array, and are paired from there.
    """
    s = access.where("session is not null").groupBy("session").agg(F.collect_set(F.struct("item", "ok")).alias("items"))
    x = s.select("session", "items", F.size("items").cast("long").alias("n"), F.explode("items").alias("x"))
    y = x.select("session", F.col("x.ok").alias("ok"), F.col("x.item").alias("a"), F.explode(F.filter("items", lambda i: i["item"] > F.col("x.item"))["item"]).alias("b"), "n")
    return y.select("session", "ok", "a", "b", "n")


def hebbian_edges(access: DataFrame, eta: float = ETA) -> DataFrame:
    """Posterior of each pair after all sessions: factors ln(1 + n / 2) add up, so one aggregation replaces the fold."""
    p = coaccess_pairs(access).withColumn("step", eta * F.log(1 + F.col("n") / 2))
    g = p.groupBy("a", "b").agg((F.lit(ALPHA) + F.sum(F.when(F.col("ok"), F.col("step")).otherwise(0.0))).alias("alpha"), (F.lit(BETA) + F.sum(F.when(F.col("ok"), 0.0).otherwise(F.col("step")))).alias("beta"))
    return g.withColumns({"weight": beta_weight(F.col("alpha"), F.col("beta")), "confidence": beta_confidence(F.col("alpha"), F.col("beta"))})


def beta_weight(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.001), F.least(F.lit(0.999), a / (a + b)))


def beta_confidence(a: Column, b: Column) -> Column:
    """1 - 4 variances, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - 4 * (a * b) / ((a + b) * (a + b) * (a + b + 1))))


def digamma(x: Column) -> Column:
    """Asymptotic digamma, x raised to 6 or more by recurrence."""
    low = F.lit(0.0)
    for i in range(6):
        low = low - F.when(x < 6, 1 / (x + i)).otherwise(0.0)
    z = F.when(x < 6, x + 6).otherwise(x)
    return low + F.log(z) - 1 / (2 * z) - 1 / (12 * z * z) + 1 / (120 * z * z * z * z)


def ln_gamma(x: Column) -> Column:
    """Stirling's series, x raised to 6 or more by recurrence."""
    low = F.lit(0.0)
    for i in range(6):
        low = low + F.when(x < 6, F.log(x + i)).otherwise(0.0)
    z = F.when(x < 6, x + 6).otherwise(x)
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) - low


def beta_entropy(a: Column, b: Column) -> Column:
    return ln_gamma(a) + ln_gamma(b) - ln_gamma(a + b) - (a - 1) * digamma(a) - (b - 1) * digamma(b) + (a + b - 2) * digamma(a + b)


def advantages(edges: DataFrame) -> DataFrame:
    """edges (kind, reward, ...) with the z-score of the reward in its kind; a group of one has 0.5 or -0.5."""
    w = W.partitionBy("kind")
    z = (F.col("reward") - F.avg("reward").over(w)) / F.greatest(F.stddev_pop("reward").over(w), F.lit(1e-8))
    return edges.withColumn("advantage", F.when(F.count("*").over(w) == 1, F.when(F.col("reward") > 0.5, 0.5).otherwise(-0.5)).otherwise(z))


def clipped_update(weight: Column, advantage: Column, eta: float = 0.01, epsilon: float = 0.2) -> Column:
    return F.greatest(F.lit(0.01), F.least(F.lit(100.0), weight * F.exp(F.greatest(F.lit(-epsilon), F.least(F.lit(epsilon), eta * advantage)))))


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """rows with `i`, their place from 0 in the order of `key`: sorted by ranges, counted by range, numbered within each."""
    cut = rows.repartitionByRange(key).sortWithinPartitions(key).withColumn("part", F.spark_partition_id())
    before = cut.groupBy("part").count().withColumn("before", F.sum("count").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)))  # a row per range
    at = cut.withColumn("at", F.row_number().over(W.partitionBy("part").orderBy(key)))
    return at.join(F.broadcast(before), "part").withColumn("i", F.col("at") - 1 + F.coalesce("before", F.lit(0))).drop("part", "at", "count", "before")


def bootstrap_interval(rows: DataFrame, key: str, value: str, resamples: int = 1000, level: float = 0.95, block: int = 4096) -> DataFrame:
    """Bootstrap interval (low, high) of the mean of `value`; an empty table gives nulls.

    Draw j of resample r is row md5("r,j") (its first 60 bits) modulo n in the order of `key`, with
    replacement and the same anywhere. Draws are made in blocks, so no row or task holds a resample.
    """
    rows = rows.where(F.col(value).isNotNull())
    n = rows.agg(F.count("*").alias("n"))  # one row
    blocks = rows.sparkSession.range(resamples).withColumnRenamed("id", "r").crossJoin(F.broadcast(n)).where("n > 0")
    blocks = blocks.select("r", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))).alias("first"))
    blocks = blocks.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "r", "first")  # few small rows of much work: without a number they would meet in one task
    draws = blocks.select("r", "n", F.explode(F.sequence("first", F.least(F.col("first") + block, F.col("n")) - 1)).alias("j"))
    draws = draws.select("r", (F.conv(F.substring(F.md5(F.concat_ws(",", F.col("r").cast("string"), F.col("j").cast("string"))), 1, 15), 16, 10).cast("long") % F.col("n")).alias("i"))
    # Draws are made from one row, so their size is underrated: the hint keeps them from being broadcast.
    means = draws.join(numbered(rows.select(key, value), key).hint("shuffle_hash"), "i").groupBy("r").agg(F.avg(value).alias("m"))
    at = means.select("m", (F.row_number().over(W.orderBy("m")) - 1).alias("k"))  # a row per resample
    low, high = int(resamples * (1 - level) / 2 + 1e-9), int(resamples * (1 + level) / 2 + 1e-9)
    return at.agg(F.max(F.when(F.col("k") == low, F.col("m"))).alias("low"), F.max(F.when(F.col("k") == high, F.col("m"))).alias("high"))
