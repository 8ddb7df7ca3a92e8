"""Usage, cost and compaction over the conversations; tool blocks, which no table has, are derived from turns and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import byte_token_estimate, collapse_spaces
from quarry.operators import conversation as C
from quarry.operators import similarity as S
from quarry.plans.common import table

_MODELS = ("haiku-x", "Opus-9", "sonnet", "gpt-4o-mini", "deepseek-chat", "deepseek-v9", "grok-2", "kimi", "unknown")


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A usage row a turn: the four counters from the text's length, and a model by conversation."""
    c, n = table(spark, sf_dir, "conversations"), F.octet_length("text").cast("long")
    model = F.element_at(F.array(*map(F.lit, _MODELS)), (F.col("conv_id") % len(_MODELS) + 1).cast("int"))
    return c.select("conv_id", "turn", model.alias("model"), n.alias("input"), (n % 97).alias("output"), (n % 31).alias("cache_write"), (n % 53).alias("cache_read"))


_USAGE = f"(SELECT conv_id, turn, [{', '.join(repr(m) for m in _MODELS)}][conv_id % {len(_MODELS)} + 1] AS model, strlen(text) AS input, strlen(text) % 97 AS output, strlen(text) % 31 AS cache_write, strlen(text) % 53 AS cache_read FROM conversations)"
_KINDS = ("input", "output", "cache_write", "cache_read")


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    return u.groupBy("conv_id").agg(F.count("*").alias("turns"), *[F.sum(k).alias(k) for k in _KINDS], F.max("turn").alias("latest_turn"), F.max_by("input", "turn").alias("latest_input"))


def usage_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    costs = [F.col(k) / 1e6 * C.price(F.col("model"), i) for i, k in enumerate(_KINDS)]
    total = costs[0] + costs[1] + costs[2] + costs[3]
    return u.groupBy("conv_id", "model").agg(F.round(F.sum(total), 6).alias("usd"))


def _cost_sql() -> str:
    def rate(i):
        case = " ".join(f"WHEN {' OR '.join(f'contains(lower(model), {n!r})' for n in names)} THEN {p[i]}" for names, p in C.PRICES)
        return f"CASE {case} ELSE {C.DEFAULT_PRICES[i]} END"

    return f"SELECT conv_id, model, round(sum({' + '.join(f'{k} / 1e6 * ({rate(i)})::DOUBLE' for i, k in enumerate(_KINDS))}), 6) AS usd FROM {_USAGE} GROUP BY ALL"


def usage_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.size(F.filter(F.split(collapse_spaces(F.col("text")), " "), lambda w: w != ""))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.sum(F.when(F.col("role") == "user", n).otherwise(0)).over(w).alias("words_in"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).over(w).alias("words_out"))


def conversation_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(*[F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")], F.array_join(F.sort_array(F.collect_set("role")), ",").alias("roles"))


def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chatty_runs(table(spark, sf_dir, "conversations"), least=2, max_bytes=200)


def compaction_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compaction_split(table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 2, "tool").otherwise(F.col("role"))))


def needs_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.needs_compaction(table(spark, sf_dir, "conversations"), least=2, tokens=200)


def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last three turns a role, in order."""
    r = F.row_number().over(W.partitionBy("conv_id", "role").orderBy(F.desc("turn")))
    return table(spark, sf_dir, "conversations").withColumn("r", r).where("r <= 3").select("conv_id", "role", "turn", (4 - F.col("r")).alias("place"))


def turn_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns within the first eight and a running budget of 200 words."""
    n = F.size(F.filter(F.split(collapse_spaces(F.col("text")), " "), lambda w: w != ""))
    w = W.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").withColumns({"r": F.row_number().over(w), "words": F.sum(n).over(w.rowsBetween(W.unboundedPreceding, 0))})
    return c.select("conv_id", "turn", ((F.col("r") <= 8) & (F.col("words") <= 200)).alias("kept"), "words")


def _ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads and writes of files, a user's events in order: purchases write, other events read, and value names the file."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.col("event_id").alias("idx"), F.floor(F.col("value") % 5).cast("long").alias("path"), (F.col("event_type") == "purchase").alias("writes"))


_OPS = "(SELECT user_id AS session, event_id AS idx, floor(value % 5)::BIGINT AS path, event_type = 'purchase' AS writes FROM events)"


def supersede(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays: operations not before the last write of their file, or of files with one operation."""
    w = W.partitionBy("session", "path")
    o = _ops(spark, sf_dir).withColumns({"last": F.max(F.when(F.col("writes"), F.col("idx"))).over(w), "n": F.count("*").over(w)})
    return o.where((F.col("n") < 2) | F.col("last").isNull() | (F.col("idx") >= F.col("last"))).select("session", "idx", "path", "writes")


def orphan_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool turns whose nearest earlier other turn is no assistant that calls tools (here: with an even length)."""
    c = table(spark, sf_dir, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 2, "tool").otherwise(F.col("role")))
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    calls = F.last(F.when(F.col("role") != "tool", (F.col("role") == "assistant") & (F.length("text") % 2 == 0)), ignorenulls=True).over(w)
    return c.withColumn("calls", calls).where("role = 'tool'").select("conv_id", "turn", F.coalesce(~F.col("calls"), F.lit(False)).alias("dropped"))


def flatten_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.array(F.col("role"), F.to_json(F.struct("turn")), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(F.array_join(b, "\n")).alias("flat_md5"))


def usage_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).select("conv_id", "turn", F.greatest(F.lit(0), F.col("input") - F.col("cache_read") * 4).alias("input"), "cache_read")


def assemble_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("text").alias("d")))).alias("ds"))
    return c.select("conv_id", F.md5(F.array_join(F.transform("ds", lambda x: x["d"]), "")).alias("text_md5"), F.size("ds").alias("n_deltas"))


def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated tokens and 100 of output against a window that some models have."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(byte_token_estimate(F.col("text"))).cast("long").alias("tokens"))
    limit = F.when(F.col("conv_id") % 3 == 0, 300).when(F.col("conv_id") % 3 == 1, 2000)
    return c.select("conv_id", "tokens", F.coalesce(F.col("tokens") + 100 <= limit, F.lit(True)).alias("passes"))


def cache_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turn whose cached input drops by 20 or more: by changed model, after 300 s (here: turn gaps), or unexpectedly."""
    w = W.partitionBy("conv_id").orderBy("turn")
    u = usage(spark, sf_dir).withColumns({"was": F.lag("cache_read").over(w), "old": F.lag(F.col("input") % 4).over(w)})
    reason = F.when(F.col("input") % 4 != F.col("old"), "model_changed").when(F.col("input") % 7 == 0, "ttl_expired").otherwise("unexpected")
    return u.where("was - cache_read >= 20").select("conv_id", "turn", (F.col("was") - F.col("cache_read")).alias("dropped"), reason.alias("reason"))


def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usage(spark, sf_dir)
    return u.groupBy("conv_id").agg(F.count_if(F.col("cache_read") > 26).alias("hits"), F.count_if(F.col("cache_read") <= 26).alias("misses"), F.count_if(F.col("cache_write") > 0).alias("writes"), F.sum("cache_read").alias("read"), F.max_by("cache_read", "turn").alias("last_read"))


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a message of its conversation: marks in the text stand for tools, capital letters for files, as no table has tool blocks."""
    c = table(spark, sf_dir, "conversations")
    found = {"tools": "[.?!,\n]", "files": "[A-Z]"}
    return S.message_classes(c.select(F.col("conv_id").alias("scope"), "turn", "role", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(k) for k, p in found.items()], F.octet_length("text").alias("length")))


def message_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message but the system's, with the first turn of its class and the number of messages of its conversation that are similar to it."""
    m = _messages(spark, sf_dir)
    n = S.link_counts(m, S.class_links(m))
    first = m.groupBy("class").agg(F.min("turn").alias("class_turn"))
    return n.join(first, "class").select(F.col("scope").alias("conv_id"), "turn", "class_turn", "n_links")


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return S.leader_clusters(m, S.class_links(m)).join(m.select("id", "tools", "files"), "id").withColumn("cluster", F.col("leader.turn"))


def cluster_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message but the system's, with the first turn of its cluster; null outside clusters."""
    return _clusters(spark, sf_dir).select(F.col("scope").alias("conv_id"), "turn", "cluster")


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cluster: size, tools in order and its first five files."""
    c = _clusters(spark, sf_dir).where("cluster is not null").select(F.col("scope").alias("conv_id"), "cluster", "tools", "files")
    sets = c.groupBy("conv_id", "cluster").agg(F.count("*").alias("n"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("tools")))).alias("t"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("files")))).alias("f"))
    return sets.select("conv_id", "cluster", "n", F.array_join("t", ", ").alias("tools"), F.array_join(F.slice("f", 1, 5), ", ").alias("files"))


def compress_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compress_summary(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def conversation_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole compaction: runs of short turns become one, then the tail that is kept."""
    c = table(spark, sf_dir, "conversations")
    runs = C.chatty_runs(c, least=2).select(F.col("conv_id").alias("_c"), "first_turn", "last_turn")
    j = c.join(runs, (c["conv_id"] == runs["_c"]) & c["turn"].between(F.col("first_turn"), F.col("last_turn")), "left")
    left = j.where(F.col("first_turn").isNull() | (F.col("turn") == F.col("first_turn"))).select("conv_id", "turn", "role")
    return C.compaction_split(left)


_OVERLAP = "CASE WHEN len({0}.{1}) = 0 AND len(b.{1}) = 0 THEN 1.0 ELSE len(list_intersect(a.{1}, b.{1})) / len(list_distinct(a.{1} || b.{1})) END"
#: Messages as m, and pair (conv_id, i, j) of the turns of similar ones.
_SIMILAR = f"""m AS (SELECT conv_id, turn, role, list_sort(list_distinct(regexp_extract_all(text, '[.?!,\\n]'))) AS tools, list_sort(list_distinct(regexp_extract_all(text, '[A-Z]'))) AS files, strlen(text) AS length FROM conversations WHERE role <> 'system'),
  pair AS (SELECT a.conv_id, a.turn AS i, b.turn AS j FROM m a JOIN m b ON a.conv_id = b.conv_id AND a.role = b.role AND a.turn < b.turn
    WHERE 0.4 * ({_OVERLAP.format("a", "tools")}) + 0.4 * ({_OVERLAP.format("a", "files")}) + 0.2 * (CASE WHEN a.length = 0 AND b.length = 0 THEN 1.0 ELSE least(a.length, b.length) / greatest(a.length, b.length) END) >= 0.6 - 1e-9)"""
#: Clusters as assigned (conv_id, turn, cluster), turn by turn; needs _SIMILAR.
_LEADERS = """near AS (SELECT conv_id, i, list(j) AS js FROM pair GROUP BY conv_id, i),
  walk AS (
    SELECT conv_id, list(turn ORDER BY turn) AS turns, 1 AS pos, list_transform(list(turn), lambda x: -1) AS owner FROM m GROUP BY conv_id
    UNION ALL SELECT conv_id, turns, pos + 1, CASE WHEN owner[pos] = -1 AND len(g) >= 2 THEN list_transform(owner, lambda x, k: CASE WHEN k = pos OR list_contains(g, turns[k]) THEN turns[pos] ELSE x END) ELSE owner END
    FROM (SELECT w.*, list_filter(coalesce(js, []), lambda t: owner[list_position(turns, t)] = -1) AS g FROM walk w LEFT JOIN near n ON n.conv_id = w.conv_id AND n.i = turns[pos] WHERE pos <= len(turns))),
  assigned AS (SELECT conv_id, unnest(turns) AS turn, nullif(unnest(owner), -1) AS cluster FROM walk WHERE pos = len(turns) + 1)"""
_RUNS = """
  WITH m AS (SELECT *, strlen(text) < 200 AS short FROM conversations), n AS (SELECT *, sum(CASE WHEN short AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS island
    FROM (SELECT *, lag(short) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM m))
  SELECT conv_id, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM n WHERE short GROUP BY conv_id, island HAVING count(*) >= 2"""


def _split_sql(source: str) -> str:
    return f"""
  WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before, count(*) OVER (PARTITION BY conv_id) AS n_messages FROM {source})
  SELECT conv_id, n_messages, CASE WHEN role = 'tool' AND before IS NOT NULL THEN before ELSE turn END AS first_kept FROM m WHERE r = least(4, n_messages)"""


_TOOL = "(SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'tool' ELSE role END AS role, text FROM conversations)"
_N_WORDS = "len(list_filter(string_split(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0b]+', ' ', 'g')), ' '), lambda x: x <> ''))"

QUERIES = {
    "usage_totals": (usage_totals, f"SELECT conv_id, count(*) AS turns, {', '.join(f'sum({k})::BIGINT AS {k}' for k in _KINDS)}, max(turn) AS latest_turn, arg_max(input, turn) AS latest_input FROM {_USAGE} GROUP BY conv_id"),
    "usage_cost": (usage_cost, _cost_sql()),
    "usage_words": (usage_words, f"SELECT conv_id, turn, sum(CASE WHEN role = 'user' THEN {_N_WORDS} ELSE 0 END) OVER w::BIGINT AS words_in, sum(CASE WHEN role = 'assistant' THEN {_N_WORDS} ELSE 0 END) OVER w::BIGINT AS words_out FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)".replace("OVER w::BIGINT", "OVER w").replace("SELECT conv_id, turn, sum", "SELECT conv_id, turn, words_in::BIGINT AS words_in, words_out::BIGINT AS words_out FROM (SELECT conv_id, turn, sum") + ")"),
    "conversation_scope": (conversation_scope, "SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, array_to_string(list_sort(list(DISTINCT role)), ',') AS roles FROM conversations GROUP BY conv_id"),
    "collapse_runs": (collapse_runs, _RUNS),
    "compaction_split": (compaction_split, _split_sql(_TOOL)),
    "needs_compaction": (needs_compaction, "SELECT conv_id, n, tokens, n > 2 AND tokens >= 200 AS needs FROM (SELECT conv_id, count(*) AS n, sum(strlen(text) // 4 + 1)::BIGINT AS tokens FROM conversations GROUP BY conv_id)"),
    "recent_requests": (recent_requests, "SELECT conv_id, role, turn, 4 - r AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 3"),
    "turn_budget": (turn_budget, f"SELECT conv_id, turn, r <= 8 AND words <= 200 AS kept, words::BIGINT AS words FROM (SELECT *, row_number() OVER w AS r, sum({_N_WORDS}) OVER w AS words FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"),
    "supersede": (supersede, f"SELECT session, idx, path, writes FROM (SELECT *, max(CASE WHEN writes THEN idx END) OVER (PARTITION BY session, path) AS last, count(*) OVER (PARTITION BY session, path) AS n FROM {_OPS}) WHERE n < 2 OR last IS NULL OR idx >= last"),
    "orphan_tools": (orphan_tools, f"""
        SELECT conv_id, turn, coalesce(NOT calls, false) AS dropped FROM (SELECT *, last_value(CASE WHEN role <> 'tool' THEN role = 'assistant' AND length(text) % 2 = 0 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calls FROM {_TOOL}) WHERE role = 'tool'"""),
    "flatten_blocks": (flatten_blocks, "SELECT conv_id, turn, md5(role || chr(10) || '{\"turn\":' || turn || '}' || chr(10) || text) AS flat_md5 FROM conversations"),
    "usage_normalize": (usage_normalize, f"SELECT conv_id, turn, greatest(0, input - cache_read * 4) AS input, cache_read FROM {_USAGE}"),
    "assemble_deltas": (assemble_deltas, "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5, count(*) AS n_deltas FROM conversations GROUP BY conv_id"),
    "preflight": (preflight, "SELECT conv_id, tokens, coalesce(tokens + 100 <= CASE conv_id % 3 WHEN 0 THEN 300 WHEN 1 THEN 2000 END, true) AS passes FROM (SELECT conv_id, sum(strlen(text) // 4 + 1)::BIGINT AS tokens FROM conversations GROUP BY conv_id)"),
    "cache_breaks": (cache_breaks, f"""
        SELECT conv_id, turn, was - cache_read AS dropped, CASE WHEN input % 4 <> old THEN 'model_changed' WHEN input % 7 = 0 THEN 'ttl_expired' ELSE 'unexpected' END AS reason
        FROM (SELECT *, lag(cache_read) OVER w AS was, lag(input % 4) OVER w AS old FROM {_USAGE} WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE was - cache_read >= 20"""),
    "cache_stats": (cache_stats, f"SELECT conv_id, count(*) FILTER (cache_read > 26) AS hits, count(*) FILTER (cache_read <= 26) AS misses, count(*) FILTER (cache_write > 0) AS writes, sum(cache_read)::BIGINT AS read, arg_max(cache_read, turn) AS last_read FROM {_USAGE} GROUP BY conv_id"),
    "message_similarity": (message_similarity, f"""
        WITH {_SIMILAR}
        SELECT m.conv_id, m.turn, min(c.turn) AS class_turn, any_value(coalesce(k.n, 0)) AS n_links FROM m JOIN m c ON c.conv_id = m.conv_id AND c.role = m.role AND c.tools = m.tools AND c.files = m.files
        LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM (SELECT conv_id, i AS turn FROM pair UNION ALL SELECT conv_id, j FROM pair) GROUP BY ALL) k ON k.conv_id = m.conv_id AND k.turn = m.turn GROUP BY m.conv_id, m.turn"""),
    "cluster_messages": (cluster_messages, f"WITH RECURSIVE {_SIMILAR}, {_LEADERS} SELECT conv_id, turn, cluster FROM assigned"),
    "cluster_summary": (cluster_summary, f"""
        WITH RECURSIVE {_SIMILAR}, {_LEADERS} SELECT conv_id, cluster, count(*) AS n, array_to_string(list_sort(list_distinct(flatten(list(tools)))), ', ') AS tools, array_to_string(list_sort(list_distinct(flatten(list(files))))[1:5], ', ') AS files
        FROM assigned JOIN m USING (conv_id, turn) WHERE cluster IS NOT NULL GROUP BY conv_id, cluster"""),
    "compress_summary": (compress_summary, None),
    "conversation_compaction": (conversation_compaction, _split_sql(f"(SELECT c.conv_id, c.turn, c.role FROM conversations c LEFT JOIN ({_RUNS}) r ON c.conv_id = r.conv_id AND c.turn BETWEEN first_turn AND last_turn WHERE first_turn IS NULL OR c.turn = first_turn)")),
}
