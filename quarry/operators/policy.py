"""Operators over claims, locks and policies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scope_collisions(claims: DataFrame, group: str, owner: str, scope: str, separator: str = "/") -> DataFrame:
    """Owners of a group whose scopes are equal or lie one within the other: (group, owner, scope, others).

    `scope` is the shorter scope of a collision, `others` the number of other owners that the
    owner collides with over it. An owner of exactly that scope collides with all other rows
    of (group, scope); one of a narrower scope only with those of exactly that scope. So the
    result has a row for each owner and scope above its own, never a row for each pair.
    Rows with a null in one of the columns and repeated rows change nothing.
    """
    c = claims.select(F.col(group).alias("g"), F.col(owner).alias("o"), F.col(scope).alias("s")).dropna()
    parts = F.split("s", F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    held = c.select("g", "o", "s", F.explode(above).alias("p")).groupBy("g", "p", "o").agg(F.max(F.col("p") == F.col("s")).alias("exact"))
    n = held.groupBy("g", "p").agg(F.count("*").alias("n"), F.count_if("exact").alias("n_exact")).where("n_exact > 0 and n > 1")
    others = F.when(F.col("exact"), F.col("n") - 1).otherwise(F.col("n_exact"))
    return held.join(n, ["g", "p"]).select(F.col("g").alias(group), F.col("o").alias(owner), F.col("p").alias(scope), others.alias("others")).where("others > 0")
