"""Ordered rows of groups: cuts by size, budgets, lineage of any length, and how long something has held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators.common import written

ROTATE_BYTES = 256 << 10
FILE_CHARS, TOTAL_CHARS = 4_000, 12_000
TRUNCATED = "\n\n[truncated]"


def rotations(rows: DataFrame, limit: int = ROTATE_BYTES) -> DataFrame:
    """rows (scope, pos, bytes, ...) with `part`, from 0: a row goes to a new part once the part before it holds `limit` bytes or more.

    From the sums up to each row, every row's part would end at the first row that fills it; the
    row after that starts the next one. Rows that can be reached so from a scope's first are
    found by doubling the steps, in as many rounds as the number of parts has bits. pos orders a scope's rows and is unique
    there; a null size counts as 0, rows without a pos are left out.
    """
    r = rows.where("pos is not null").withColumn("_scope", F.coalesce(F.concat(F.lit("="), F.col("scope").cast("string")), F.lit(""))).withColumn("_size", F.coalesce("bytes", F.lit(0)).cast("long"))
    w = W.partitionBy("_scope").orderBy("pos")
    r = written(r.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum("_size").over(w)), "sums")
    ends = r.select("_scope", F.col("_sum").alias("v"), F.col("_n").alias("end"), F.lit(None).cast("int").alias("start"))
    asks = r.select("_scope", (F.col("_sum") - F.col("_size") + limit).alias("v"), F.lit(None).cast("int").alias("end"), F.col("_n").alias("start"))
    down = W.partitionBy("_scope").orderBy(F.desc("v"), F.asc_nulls_last("end")).rowsBetween(W.unboundedPreceding, 0)  # ends with as much come before the row that asks
    least = ends.unionByName(asks).withColumn("_end", F.min("end").over(down)).where("start is not null")
    # An end before the start itself can't fill its part, unless nothing is asked for.
    step = written(least.where("_end is not null").select("_scope", "start", (F.greatest("_end", "start") + 1).alias("next")), "next")
    reached = r.where("_n = 1").select("_scope", F.col("_n").alias("start"))
    while not step.isEmpty():
        more = reached.join(step, ["_scope", "start"]).select("_scope", F.col("next").alias("start"))
        reached = written(reached.unionByName(more).distinct(), "reached")
        then = step.select("_scope", F.col("start").alias("next"), F.col("next").alias("_then"))
        step = written(step.join(then, ["_scope", "next"]).select("_scope", "start", F.col("_then").alias("next")), "next")
    starts = reached.select("_scope", F.col("start").alias("_n"), F.lit(1).alias("_new"))
    out = r.join(starts, ["_scope", "_n"], "left")
    part = F.sum(F.coalesce("_new", F.lit(0))).over(W.partitionBy("_scope").orderBy("pos")) - 1
    return out.withColumn("part", part).select(*rows.columns, "part")


def budgeted_texts(files: DataFrame, file_chars: int = FILE_CHARS, total_chars: int = TOTAL_CHARS) -> DataFrame:
    """files (scope, pos, text) with `shown`: the trimmed texts in order, each cut to file_chars and to what total_chars has left, with a mark where they are; null once nothing is left.

    The mark counts towards the total, and a cut that its mark takes beyond file_chars is cut
    again. A null text is empty. Every text costs its length or, if that is beyond file_chars, as much
    and the mark, until the total is spent; so what is left before a text is a running sum.
    """
    f = files.withColumn("_t", F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "")).withColumn("_l", F.length("_t"))
    cost = F.when(F.col("_l") > file_chars, file_chars + len(TRUNCATED)).otherwise(F.col("_l"))
    before = F.coalesce(F.sum(cost).over(W.partitionBy("scope").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("_left", F.greatest(F.lit(0), F.lit(total_chars) - before)).withColumn("_limit", F.least(F.lit(file_chars), F.col("_left")))
    raw = F.concat(F.expr("substring(_t, 1, _limit)"), F.lit(TRUNCATED))
    cut = F.when(F.length(raw) > file_chars, F.concat(F.substring(raw, 1, file_chars), F.lit(TRUNCATED))).otherwise(raw)
    shown = F.when(F.col("_left") == 0, F.lit(None)).when(F.col("_l") <= F.col("_limit"), F.col("_t")).otherwise(cut)
    return f.withColumn("shown", shown.cast("string")).drop("_t", "_l", "_left", "_limit")


def lineage(items: DataFrame) -> DataFrame:
    """(item, root, depth, in_cycle) of items (item, parent): where the parents lead to, and in how many steps.

    A parent that is null, the item itself or no item ends the way there. Each round doubles the steps that an item has gone,
    so a chain of a thousand takes ten. Items that lead into a circle have no root and no
    depth; in_cycle tells whether they are part of it or lead to it. Of an item that repeats, the smallest parent counts.
    """
    one = items.where("item is not null").groupBy("item").agg(F.min("parent").alias("parent"))
    known = one.select(F.col("item").alias("parent"))
    up = one.where("parent <> item").join(known, "parent", "left_semi").select("item", "parent")
    at = written(up.select("item", F.col("parent").alias("at"), F.lit(1).cast("long").alias("depth")), "lineage")
    gone = 1
    while True:
        on = at.select(F.col("item").alias("at"), F.col("at").alias("further"), F.col("depth").alias("more"))
        step = written(at.join(on, "at", "left").select("item", F.coalesce("further", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("open")), "lineage")
        at, gone = step.select("item", "at", "depth"), gone * 2
        if step.where("open").count() < gone:  # a way that is still open is as long as the steps gone, unless it goes round
            break
        if gone > 1 << 40:
            break
    last = at.select(F.col("item").alias("at"), F.lit(True).alias("round"))
    ends = at.join(last, "at", "left").select("item", F.when(F.col("round").isNull(), F.col("at")).alias("root"), F.when(F.col("round").isNull(), F.col("depth")).alias("depth"), F.col("round").isNotNull().alias("in_cycle"))
    return one.select("item").join(ends, "item", "left").select("item", F.when(F.coalesce("in_cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("root", "item")).alias("root"), F.when(F.coalesce("in_cycle", F.lit(False)), F.lit(None)).otherwise(F.coalesce("depth", F.lit(0))).cast("long").alias("depth"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))


def ancestors(items: DataFrame, tips: DataFrame) -> DataFrame:
    """(tip, depth, item): the whole way from each of tips (item) to its root, the tip itself at depth 0; nothing for tips that lead into a circle.

    Where a tip stands after d steps is found by the bits of d, one join for each bit.
    """
    found = lineage(items)
    one = items.where("item is not null and parent <> item").groupBy("item").agg(F.min("parent").alias("parent"))
    jump = written(one.join(found.where("not in_cycle and depth > 0").select("item"), "item", "left_semi"), "jump")
    way = tips.select(F.col("item")).distinct().join(found.where("not in_cycle").select("item", F.col("depth").alias("total")), "item")
    longest = way.agg(F.max("total")).first()[0] or 0
    way = way.select(F.col("item").alias("tip"), "item", F.explode(F.sequence(F.lit(0).cast("long"), "total")).alias("depth"))
    for bit in range(int(longest).bit_length()):
        on = jump.select("item", F.col("parent").alias("next"))
        way = way.join(on, "item", "left").withColumn("item", F.when(F.col("depth").bitwiseAND(F.lit(1 << bit)) != 0, F.col("next")).otherwise(F.col("item"))).select("tip", "depth", "item")
        twice = jump.select(F.col("item").alias("parent"), F.col("parent").alias("further"))
        jump = written(jump.join(twice, "parent").select("item", F.col("further").alias("parent")), "jump")
    return way.select("tip", "depth", "item")


def holding(states: DataFrame) -> DataFrame:
    """(key, since, until) of states (key, ts, seq, holds): the times in which something held, until null while it does.

    A state holds until the next of its key, by ts and then seq; neighbouring ones that hold
    join. Rows without a key or a ts are left out; a null state doesn't hold.
    """
    w = W.partitionBy("key").orderBy("ts", "seq")
    s = states.where("key is not null and ts is not null").select("key", "ts", "seq", F.coalesce("holds", F.lit(False)).alias("holds"))
    s = s.withColumn("was", F.lag("holds").over(w)).where(~F.col("holds").eqNullSafe(F.col("was")))
    return s.withColumn("until", F.lead("ts").over(w)).where("holds").select("key", F.col("ts").alias("since"), "until").where("until is null or until > since")


def held_for(spans: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    """(key, since, held_s, due): of the spans of `holding` those that hold at a time, for how many seconds, and whether that is `seconds` or more."""
    now = as_of.cast("timestamp")
    open_ = spans.where((F.col("since") <= now) & (F.col("until").isNull() | (F.col("until") > now)))
    held = F.unix_seconds(now) - F.unix_seconds(F.col("since").cast("timestamp"))
    return open_.select("key", "since", held.alias("held_s"), (held >= seconds).alias("due"))
