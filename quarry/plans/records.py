"""Paths under ignore files, logs cut by size, lineage, durations, byte codecs and nested JSON over the supplied tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import codecs as C
from quarry.operators import globs as G
from quarry.operators import merging as M
from quarry.operators import sequences as Q
from quarry.plans.common import table
from quarry.plans.ingest import _FILES, _files

#: Ignore files of the made workspace: folder, name, text.
IGNORE = (
    ("", ".gitignore", "# kinds\n*.dat\nvendor/\n/src1/src\n!src1/src/core/1.rs\nsrc4/**/*.md\n"),
    ("", ".ignore", "src5/web/\n"),
    ("src2", ".gitignore", "*\n!*/\n!*.TSX\n!?.rs\n"),
    ("src4/docs", ".gitignore", "!guide/*[05].md\n"),
    ("src6", ".ignore", "docs/guide/*\n!docs/guide/[1-4]*.md\n"),
)


def ignore_walk(spark, sf_dir):
    """All documents as files, as a walk under those ignore files reaches them."""
    rules = spark.createDataFrame(IGNORE, "folder string, name string, text string")
    return G.not_ignored(_files(spark, sf_dir).select("path"), rules)


def search_filters(spark, sf_dir):
    """Files below two folders by a glob with braces, of one type."""
    return _files(spark, sf_dir).select("path").where(G.matches_filters(F.col("path"), "src[0-9]/{docs,web}/*", "md"))


def session_rotation(spark, sf_dir):
    """The documents of a language as a log in their order, cut once a part holds 256 KiB."""
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("scope"), F.col("doc_id").alias("pos"), F.octet_length("text").alias("bytes"))
    return Q.rotations(d).select("scope", "pos", "part")


def instruction_budget(spark, sf_dir):
    """A source's documents as instruction files: 4,000 characters each, 12,000 in all."""
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("scope"), F.col("doc_id").alias("pos"), "text")
    return Q.budgeted_texts(d).select("scope", "pos", F.md5("shown").alias("shown_md5"))


def order_lineage(spark, sf_dir):
    """Orders as items that supersede the customer's one before: the first of each line, and how far it is."""
    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.lag("o_orderkey").over(w).alias("parent"))
    return Q.lineage(o)


def held_since(spark, sf_dir):
    """Since when users have not purchased, as of the last event of all; due after six hours."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") != "purchase").alias("holds"))
    now = e.agg(F.max("ts").alias("now"))
    return Q.held_for(Q.holding(e).crossJoin(F.broadcast(now)), F.col("now"), 6 * 3600).select("key", "held_s", "due")  # one row


def text_fnv(spark, sf_dir):
    """FNV-1a of every turn's text."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.hex64(C.fnv1a(F.col("text"))).alias("fnv"))


def hash_embed(spark, sf_dir):
    """Every document's hashed projection to 64 slots, four a token."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return C.hashed_projection(d, 64).select(F.col("id").alias("doc_id"), "slot", F.round("value", 6).alias("value"))


def embedding_blob(spark, sf_dir):
    """Every embedding as a little-endian blob, and whether the floats come back from it."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<float>").alias("v")).withColumn("blob", C.floats_to_blob(F.col("v")))
    return e.select("vec_id", F.octet_length("blob").alias("bytes"), (C.blob_to_floats(F.col("blob"), 64) == F.col("v")).alias("same"))


def canonical_hash(spark, sf_dir):
    """Events as JSON, keys in an order that differs from row to row: the hash is that of the ordered one."""
    e = table(spark, sf_dir, "events")
    parts = [F.concat(F.lit('"props": '), F.col("props")), F.concat(F.lit('"id" :'), F.col("event_id").cast("string")), F.concat(F.lit('"a":[ {"y":'), F.col("user_id").cast("string"), F.lit(', "x": "'), F.col("event_type"), F.lit('"}]'))]
    mixed = F.when(F.col("event_id") % 2 == 0, F.concat_ws(" , ", *parts)).otherwise(F.concat_ws(",", *reversed(parts)))
    return e.select("event_id", C.json_hash(F.concat(F.lit("{ "), mixed, F.lit("}"))).alias("hash"))


def settings_merge(spark, sf_dir):
    """A user's events as nested settings, each with its type's part and a count; merged in order of arrival."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.lit('{"last": {"'), F.col("event_type"), F.lit('": {"props": '), F.col("props"), F.lit(', "at": '), F.col("event_id").cast("string"), F.lit('}}, "seen": ['), F.col("event_id").cast("string"), F.lit("]}"))
    return M.deep_merge(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("rank"), text.alias("text"))).select("key", "text")


_FNV = "list_reduce(list_prepend(14695981039346656037::HUGEINT, [('0x' || substr({0}, j, 2))::HUGEINT for j in range(1, len({0}), 2)]), lambda a, b: xor(a, b) * 1099511628211 % 18446744073709551616)"

QUERIES = {
    "ignore_walk": (ignore_walk, f"""
        SELECT path FROM {_FILES} WHERE NOT (
          (path LIKE '%.dat' OR regexp_matches(path, '(^|/)vendor/') OR starts_with(path, 'src1/src/') OR (starts_with(path, 'src4/') AND path LIKE '%.md' AND NOT regexp_matches(path, '^src4/docs/guide/[^/]*[05]\\.md$'))) AND NOT starts_with(path, 'src2/')
          OR starts_with(path, 'src5/web/')
          OR starts_with(path, 'src2/') AND (path LIKE '%/vendor/%' OR NOT (path LIKE '%.TSX' OR regexp_matches(path, '/[^/]\\.rs$')))
          OR starts_with(path, 'src6/docs/guide/') AND NOT regexp_matches(path, '^src6/docs/guide/[1-4][^/]*\\.md$'))"""),
    "search_filters": (search_filters, f"SELECT path FROM {_FILES} WHERE regexp_matches(path, '^src[0-9]/(docs|web)/.*\\.md$')"),
    "session_rotation": (session_rotation, """
        WITH RECURSIVE r AS (SELECT lang, doc_id, strlen(text) AS b, row_number() OVER w AS n, sum(strlen(text)) OVER w AS s FROM documents WINDOW w AS (PARTITION BY lang ORDER BY doc_id)),
        nxt AS (SELECT a.lang, a.n AS start, min(b.n) + 1 AS next FROM r a JOIN r b ON b.lang = a.lang AND b.n >= a.n AND b.s - a.s + a.b >= 262144 GROUP BY a.lang, a.n),
        p AS (SELECT DISTINCT lang, 1::BIGINT AS start FROM r UNION ALL SELECT p.lang, nxt.next FROM p JOIN nxt ON nxt.lang = p.lang AND nxt.start = p.start)
        SELECT r.lang AS scope, doc_id AS pos, (SELECT count(*) FROM p WHERE p.lang = r.lang AND p.start <= r.n) - 1 AS part FROM r"""),
    "instruction_budget": (instruction_budget, """
        WITH f AS (SELECT source, doc_id, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM documents),
        g AS (SELECT *, greatest(0, 12000 - coalesce(sum(CASE WHEN length(t) > 4000 THEN 4013 ELSE length(t) END) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rest FROM f),
        h AS (SELECT *, substr(t, 1, least(4000, rest)::BIGINT) || chr(10) || chr(10) || '[truncated]' AS raw FROM g)
        SELECT source AS scope, doc_id AS pos, md5(CASE WHEN rest = 0 THEN NULL WHEN length(t) <= least(4000, rest) THEN t WHEN length(raw) > 4000 THEN substr(raw, 1, 4000) || chr(10) || chr(10) || '[truncated]' ELSE raw END) AS shown_md5 FROM h"""),
    "order_lineage": (order_lineage, "SELECT o_orderkey AS item, first_value(o_orderkey) OVER w AS root, row_number() OVER w - 1 AS depth, false AS in_cycle FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"),
    "held_since": (held_since, """
        WITH l AS (SELECT user_id, ts, event_id, event_type <> 'purchase' AS holds, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS p FROM events),
        s AS (SELECT user_id, min(ts) AS since FROM l WHERE p IS NULL OR event_id > p GROUP BY user_id)
        SELECT user_id AS key, epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', since))::BIGINT AS held_s, epoch(date_trunc('second', (SELECT max(ts) FROM events)))::BIGINT - epoch(date_trunc('second', since))::BIGINT >= 21600 AS due FROM s"""),
    "text_fnv": (text_fnv, f"SELECT conv_id, turn, lpad(lower(hex(({_FNV.format('x')})::UBIGINT)), 16, '0') AS fnv FROM (SELECT conv_id, turn, hex(encode(text)) AS x FROM conversations)"),
    "hash_embed": (hash_embed, f"""
        WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS token FROM documents), c AS (SELECT doc_id, token, count(*) AS n FROM t GROUP BY ALL),
        h AS (SELECT token, {_FNV.format("x")} AS h FROM (SELECT DISTINCT token, hex(encode(token)) AS x FROM c)),
        v AS (SELECT doc_id, ((h + i * 2654435761::HUGEINT) % 18446744073709551616 % 64)::BIGINT AS slot, sum(n * CASE WHEN h // (1 << i) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM c JOIN h ON c.token = h.token, (SELECT unnest([0, 1, 2, 3]) AS i) GROUP BY ALL)
        SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM v WHERE v <> 0"""),
    "embedding_blob": (embedding_blob, "SELECT vec_id, 4 * len(embedding) AS bytes, true AS same FROM embeddings"),
    "canonical_hash": (canonical_hash, """
        SELECT event_id, substr(sha256('{"a":[{"x":"' || event_type || '","y":' || user_id || '}],"id":' || event_id || ',"props":' || replace(props, ' ', '') || '}'), 1, 16) AS hash FROM events"""),
    "settings_merge": (settings_merge, """
        WITH l AS (SELECT user_id, event_type, max(event_id) AS id, arg_max(replace(props, ' ', ''), event_id) AS props FROM events GROUP BY ALL)
        SELECT user_id AS key, '{"last":{' || string_agg('"' || event_type || '":{"at":' || id || ',"props":' || props || '}', ',' ORDER BY event_type) || '},"seen":[' || max(id) || ']}' AS text FROM l GROUP BY user_id"""),
}
