"""Deep merge of JSON objects: rows of paths, shadowed by later ones, put together again level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.codecs import canonical_json
from quarry.operators.common import written


def json_paths(docs: DataFrame) -> DataFrame:
    """(key, rank, path, value) of docs (key, rank, text): every member of nested objects by its path, value null for an object's own row.

    Arrays and plain values are values as a whole, in canonical JSON. One level is taken apart at a time,
    so depth is bounded by the documents alone. Texts that are no JSON object give nothing.
    """
    return _paths(_parsed(docs))


def _parsed(docs: DataFrame) -> DataFrame:
    """(key, rank, node) of the texts that are objects, parsed once: what follows takes the VARIANT apart."""
    return written(docs.select("key", "rank", F.try_parse_json("text").alias("node")), "json-parsed").where("startswith(schema_of_variant(node), 'OBJECT<')")


def _paths(objects: DataFrame) -> DataFrame:
    open_ = objects.select("key", "rank", F.array().cast("array<string>").alias("path"), "node")
    found = []
    while True:
        rows = open_.select("key", "rank", "path", F.explode(F.expr("cast(node as map<string,variant>)")).alias("name", "node"))
        deep = F.expr("startswith(schema_of_variant(node), 'OBJECT<')")
        rows = rows.select("key", "rank", F.concat("path", F.array("name")).alias("path"), F.when(~deep, F.coalesce(F.to_json("node"), F.lit("null"))).alias("value"), F.when(deep, F.col("node")).alias("node"))
        rows = written(rows, "json-level")
        found.append(rows.select("key", "rank", "path", "value"))
        open_ = rows.where("value is null").select("key", "rank", "path", "node")
        if open_.isEmpty():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def deep_merge(docs: DataFrame) -> DataFrame:
    """(key, text): of every key the objects of docs (key, rank, text) merged in the order of rank.

    Where both hold an object under one name these merge in turn; else the later value replaces the
    earlier one whole, arrays too. A path goes if a later document has a plain value at it or above it, and a plain
    value goes if a later one has an object at its path. The result is canonical JSON. Texts that are no object are left out, ranks
    must be unique for a key.
    """
    objects = _parsed(docs)
    last = _paths(objects).groupBy("key", "path").agg(F.max_by("value", "rank").alias("value"), F.max("rank").alias("rank"), F.max(F.when(F.col("value").isNotNull(), F.col("rank"))).alias("plain"))
    last = written(last.withColumn("deep", F.col("value").isNull()), "json-last")
    # An object that merged keeps what earlier ones held, back to the last plain value at or above it.
    above = last.select("key", "path", "value", "rank", "deep", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("n")).withColumn("over", F.slice("path", F.lit(1), F.col("n")))
    shadow = above.join(last.select("key", F.col("path").alias("over"), "plain"), ["key", "over"]).groupBy("key", "path").agg(F.max("plain").alias("shadow"))
    kept = last.join(shadow, ["key", "path"], "left").where("shadow is null or rank >= shadow")
    # Empty objects stay only where nothing lies below them; they are written when their level comes.
    kept = written(kept.select("key", "path", "value", "deep"), "json-kept")
    depth = kept.agg(F.max(F.size("path"))).first()[0] or 0
    keys = objects.select("key").distinct()
    below = None
    for level in range(depth, 0, -1):
        here = kept.where(F.size("path") == level)
        if below is not None:
            here = here.join(below, ["key", "path"], "left")
        text = F.when(F.col("deep"), F.coalesce("body", F.lit("{}")) if below is not None else F.lit("{}")).otherwise(F.col("value"))
        named = here.select("key", F.slice("path", 1, level - 1).alias("path"), F.struct(F.element_at("path", -1).alias("name"), text.alias("text")).alias("m"))
        quoted = F.transform(F.array_sort(F.collect_list("m")), lambda m: F.concat(_quoted(m["name"]), F.lit(":"), m["text"]))
        below = written(named.groupBy("key", "path").agg(F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}")).alias("body")), "json-level")
    if below is None:
        return keys.select("key", F.lit("{}").alias("text"))
    return keys.join(below.select("key", "body"), "key", "left").select("key", canonical_json(F.coalesce("body", F.lit("{}"))).alias("text"))


def _quoted(name):
    """A name as a JSON string."""
    row = F.to_json(F.array(name))
    return F.substr(row, F.lit(2), F.length(row) - 2)
