"""Event streams: filters, deduplication, reconciliation, policies and ledgers over the events table.

user_id is the lane, event_id the sequence number; the fields that the table lacks are derived
from event_id and value, as lane_events() says, and alike in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import policy
from quarry.plans.common import table

_PROVENANCE = ("live_lane", "test", "healthcheck", "replay", "transport")
_ENVIRONMENTS = ("prod", "staging", "dev")
_CONFIDENCE = ("high", "medium", "low", "unknown")
#: Terminal events.
TERMINAL = ("finished", "failed", "merged", "superseded", "closed")


def _pick(values: tuple, n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))


def lane_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    event = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "started").when((F.col("event_type") == "view") & (i % 11 == 0), "reconciled").otherwise("progress")
    e = e.select("event_id", F.col("user_id").alias("lane"), event.alias("event"), F.when(i % 3 == 0, "green").otherwise("red").alias("status"), F.floor(F.col("value") % 7).cast("long").alias("data"),
                 _pick(_PROVENANCE, i).alias("provenance"), F.when(i % 7 != 0, _pick(_ENVIRONMENTS, i)).alias("environment"), F.when(i % 5 != 0, _pick(_CONFIDENCE, i)).alias("confidence"), F.col("ts"))
    return e.withColumn("fingerprint", F.substring(F.sha2(F.concat_ws("|", "lane", "event", "status", "data"), 256), 1, 16))


def _in(xs) -> str:
    return ", ".join(f"'{x}'" for x in xs)


_L = f"""(SELECT *, substr(sha256(lane || '|' || event || '|' || status || '|' || data), 1, 16) AS fingerprint FROM (
  SELECT event_id, user_id AS lane, CASE WHEN event_type = 'purchase' THEN 'finished' WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' THEN 'started' WHEN event_type = 'view' AND event_id % 11 = 0 THEN 'reconciled' ELSE 'progress' END AS event,
    CASE WHEN event_id % 3 = 0 THEN 'green' ELSE 'red' END AS status, floor(value % 7)::BIGINT AS data, [{_in(_PROVENANCE)}][event_id % 5 + 1] AS provenance, CASE WHEN event_id % 7 <> 0 THEN [{_in(_ENVIRONMENTS)}][event_id % 3 + 1] END AS environment,
    CASE WHEN event_id % 5 <> 0 THEN [{_in(_CONFIDENCE)}][event_id % 4 + 1] END AS confidence, ts FROM events))"""
_T = f"event IN ({_in(TERMINAL)})"


def filter_provenance(spark, sf_dir):
    return lane_events(spark, sf_dir).where("provenance = 'replay'").select("event_id", "lane")


def filter_environment(spark, sf_dir):
    return lane_events(spark, sf_dir).where("environment = 'prod'").select("event_id", "lane")


def filter_confidence(spark, sf_dir):
    """At least medium; a missing confidence never passes."""
    rank = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).when(F.col("confidence") == "low", 1).when(F.col("confidence") == "unknown", 0)
    return lane_events(spark, sf_dir).where(rank >= 2).select("event_id", "confidence")


def live_only(spark, sf_dir):
    return lane_events(spark, sf_dir).where(~F.col("provenance").isin("test", "healthcheck", "replay")).select("event_id", "provenance")


def terminality(spark, sf_dir):
    t = F.when(F.col("event").isin(*TERMINAL), "terminal").when(F.col("event") == "reconciled", "uncertainty").otherwise("advisory")
    return lane_events(spark, sf_dir).select("event_id", t.alias("terminality"))


def material_change(spark, sf_dir):
    """Whether event, status or data differ from the lane's previous ones."""
    w = W.partitionBy("lane").orderBy("event_id")
    e = lane_events(spark, sf_dir)
    differs = F.lit(False)
    for c in ("event", "status", "data"):
        differs = differs | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return e.select("event_id", differs.alias("differs"))


def task_list(spark, sf_dir):
    return lane_events(spark, sf_dir).where("status = 'green'").orderBy("event_id").select("event_id", "lane")


def dedupe_commits(spark, sf_dir):
    """The latest event of each commit (lane and data); rows that name a successor go, those without a commit stay."""
    e = lane_events(spark, sf_dir).where(F.col("event_id") % 13 != 0).withColumn("commit", F.when(F.col("event_id") % 4 != 0, F.concat_ws("-", "lane", "data")))
    r = F.row_number().over(W.partitionBy("commit").orderBy(F.desc("event_id")))
    return e.withColumn("r", r).where("commit is null or r = 1").select("event_id", "commit")


def dedupe_terminal(spark, sf_dir):
    """The first of each fingerprint among terminal events; all others stay."""
    t = F.col("event").isin(*TERMINAL)
    r = F.row_number().over(W.partitionBy("fingerprint", t).orderBy("event_id"))
    return lane_events(spark, sf_dir).withColumn("r", r).where(~t | (F.col("r") == 1)).select("event_id", "event")


def reconcile_terminal(spark, sf_dir):
    """A lane's last terminal event, relabelled if a reconciliation follows its first one; none without a terminal."""
    e = lane_events(spark, sf_dir)
    t = F.col("event").isin(*TERMINAL)
    g = e.groupBy("lane").agg(F.min(F.when(t, F.col("event_id"))).alias("first"), F.max_by(F.when(t, F.col("event")), F.when(t, F.col("event_id"))).alias("event"), F.max(F.when(t, F.col("event_id"))).alias("seq"), F.max(F.when(F.col("event") == "reconciled", F.col("event_id"))).alias("doubt"))
    return g.where("first is not null").select("lane", "seq", F.when(F.col("doubt") > F.col("first"), "reconciled").otherwise(F.col("event")).alias("event"))


def nudge_class(spark, sf_dir):
    """A nudge (progress) is new, a retry of the same fingerprint, or stale once its lane is finished."""
    e = lane_events(spark, sf_dir)
    w = W.partitionBy("lane").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    f = W.partitionBy("fingerprint").orderBy("event_id").rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumns({"over": F.max(F.when(F.col("event") == "finished", 1)).over(w), "seen": F.count("*").over(f)})
    return e.where("event = 'progress'").select("event_id", F.when(F.col("over") == 1, "stale").when(F.col("seen") > 0, "retry").otherwise("new").alias("nudge"))


def lane_board(spark, sf_dir):
    """Lanes by state and freshness two hours before the last event of all."""
    e = lane_events(spark, sf_dir)
    now = e.agg(F.max("ts").alias("now"))
    g = e.groupBy("lane").agg(F.max("ts").alias("seen"), F.max_by("event", "event_id").alias("event")).crossJoin(F.broadcast(now))
    age = F.unix_timestamp(F.col("now").cast("timestamp")) - F.unix_timestamp(F.col("seen").cast("timestamp"))
    state = F.when(F.col("event").isin(*TERMINAL), "finished").when(F.col("event") == "reconciled", "blocked").otherwise("active")
    fresh = F.when(age > 86400, "stalled").when(age > 7200, "quiet").otherwise("fresh")
    return g.groupBy(state.alias("state"), fresh.alias("freshness")).agg(F.count("*").alias("n"))


def counts_by_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type")


def distinct_ordered(spark, sf_dir):
    """A lane's distinct data values in order of first occurrence."""
    f = lane_events(spark, sf_dir).groupBy("lane", "data").agg(F.min("event_id").alias("p"))
    return f.withColumn("rank", F.row_number().over(W.partitionBy("lane").orderBy("p"))).select("lane", "rank", "data")


def duplicate_ids(spark, sf_dir):
    return lane_events(spark, sf_dir).groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1")


def recovery_ledger(spark, sf_dir):
    """Failures of a lane in order: the first is an attempt at recovery, later ones are exhausted and escalate."""
    n = F.row_number().over(W.partitionBy("lane", "data").orderBy("event_id"))
    steps = F.element_at(F.array(*map(F.lit, ("restart", "rebase", "retry", "clean", "rerun", "reauth", "wait"))), (F.col("data") + 1).cast("int"))
    return lane_events(spark, sf_dir).where("event = 'failed'").select("event_id", n.alias("attempt"), steps.alias("step"), F.when(n > 1, "escalate").otherwise("attempt").alias("outcome"))


def fingerprint(spark, sf_dir):
    return lane_events(spark, sf_dir).select("event_id", "fingerprint")


def report_hash(spark, sf_dir):
    """A lane's claims sorted and hashed, so the order they came in does not matter."""
    g = lane_events(spark, sf_dir).groupBy("lane").agg(F.sort_array(F.collect_list(F.concat_ws(":", "event", "status", "data"))).alias("xs"))
    return g.select("lane", F.sha2(F.array_join("xs", ","), 256).alias("report_hash"))


def report_projection(spark, sf_dir):
    """Events by what a consumer of level 1 may see: secret ones go, text of restricted ones is replaced, its hash kept."""
    level = F.col("event_id") % 4
    e = lane_events(spark, sf_dir).where(level < 3)
    text = F.concat_ws(" ", "event", "status")
    return e.select("event_id", F.when(level <= 1, text).otherwise("<redacted>").alias("text"), F.when(level > 1, F.sha2(text, 256)).alias("original_hash"))


def validate_rows(spark, sf_dir):
    """All errors of each row, not the first."""
    errors = F.array_compact(F.array(F.when(F.col("environment").isNull(), "environment: missing"), F.when(F.col("confidence").isNull(), "confidence: missing"), F.when(F.col("data") > 5, "data: too large")))
    return lane_events(spark, sf_dir).select("event_id", F.array_join(errors, "; ").alias("errors"), F.size(errors).alias("n_errors"))


def board_validate(spark, sf_dir):
    """Fingerprints that repeat or rows with a status outside the enumeration."""
    n = F.count("*").over(W.partitionBy("fingerprint"))
    return lane_events(spark, sf_dir).select("event_id", (n > 1).alias("repeated"), (~F.col("status").isin("green")).alias("bad_status"))


def path_scope(spark, sf_dir):
    """Whether every path of a payload lies under /src."""
    p = F.concat_ws(" ", F.concat(F.lit("/src/"), "source"), F.when(F.col("doc_id") % 5 == 0, "/etc/passwd"), F.when(F.col("doc_id") % 3 == 0, "/src2/x"))
    paths = F.filter(F.split(p, " "), lambda x: F.startswith(x, F.lit("/")))
    return table(spark, sf_dir, "documents").select("doc_id", F.forall(paths, lambda x: (x == "/src") | F.startswith(x, F.lit("/src/"))).alias("allowed"))


_RULES = ((1, "deny", "error", "exact", "3"), (2, "ask", "click", "prefix", "1"), (3, "allow", "view", "any", ""), (4, "allow", "click", "any", ""), (5, "deny", "view", "prefix", "9"))


def rule_match(spark, sf_dir):
    """The first rule (by order) that names the event type and whose test holds for the value's digits."""
    rules = spark.createDataFrame(_RULES, "ordinal int, decision string, tool string, kind string, subject string")
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.floor("value").cast("string").alias("v"))
    holds = (F.col("kind") == "any") | ((F.col("kind") == "exact") & (F.col("v") == F.col("subject"))) | ((F.col("kind") == "prefix") & F.startswith("v", "subject"))
    j = e.join(F.broadcast(rules), (F.col("event_type") == F.col("tool")) & holds)
    return j.groupBy("event_id").agg(F.min(F.struct("ordinal", "decision")).alias("b")).select("event_id", "b.ordinal", "b.decision")


def authz_decision(spark, sf_dir):
    """Denied tools, then deny rules, then a hook's word, then ask rules, then allow rules and modes, then a prompt to escalate."""
    i = F.col("event_id")
    mode, need = i % 4, (F.col("user_id") % 3)
    hook = F.when(i % 10 == 0, "deny").when(i % 10 == 1, "ask").when(i % 10 == 2, "allow")
    ask, allow = i % 9 == 0, i % 8 == 0
    ok = allow | (mode >= need)
    out = F.when(F.col("event_type") == "error", "deny").when(i % 17 == 0, "deny").when(hook == "deny", "deny").when(hook == "ask", "prompt").when(ask, "prompt").when(ok, "allow").when((mode == 1) & (need == 2), "prompt").otherwise("deny")
    return table(spark, sf_dir, "events").select("event_id", out.alias("decision"))


def grant_validation(spark, sf_dir):
    """The first failed test of a grant: status, expiry, uses, scope, executor."""
    i = F.col("event_id")
    status = _pick(("granted", "granted", "pending", "consumed", "expired", "revoked"), i)
    out = F.when(status != "granted", F.concat(F.lit("status_"), status)).when(F.col("value") > 90, "expired").when(i % 4 >= 3, "already_consumed").when(i % 5 == 0, "scope_mismatch").when(i % 7 == 0, "unauthorized_delegate").otherwise("valid")
    return table(spark, sf_dir, "events").select("event_id", out.alias("outcome"))


_POLICIES = ((10, 1, "closeout", True, None, None), (20, 2, "merge", None, True, None), (20, 3, "retry", False, None, 1), (30, 4, "notify", None, None, 2), (5, 5, "escalate", None, False, 3))


def policy_actions(spark, sf_dir):
    """Rules that hold for each lane, by priority and then order; conditions that are null always hold."""
    rules = spark.createDataFrame(_POLICIES, "priority int, ordinal int, action string, completed boolean, green boolean, min_failures int")
    c = lane_events(spark, sf_dir).groupBy("lane").agg(F.max(F.col("event") == "finished").alias("done"), F.max_by(F.col("status") == "green", "event_id").alias("is_green"), F.count_if(F.col("event") == "failed").alias("failures"))
    holds = (F.col("completed").isNull() | (F.col("completed") == F.col("done"))) & (F.col("green").isNull() | (F.col("green") == F.col("is_green"))) & (F.col("min_failures").isNull() | (F.col("failures") >= F.col("min_failures")))
    j = c.join(F.broadcast(rules), holds)
    return j.withColumn("rank", F.row_number().over(W.partitionBy("lane").orderBy("priority", "ordinal"))).select("lane", "rank", "action")


def lane_completion(spark, sf_dir):
    """Lanes that have finished, are green and did not fail last, and so may be closed."""
    c = lane_events(spark, sf_dir).groupBy("lane").agg(F.max(F.col("event") == "finished").alias("done"), F.max_by("status", "event_id").alias("status"), F.max_by("event", "event_id").alias("last"))
    return c.where("done and status = 'green' and last <> 'failed'").select("lane", F.lit("closeout").alias("action"))


def substring_join(spark, sf_dir):
    """Items whose text contains a token (tokens: the distinct event types)."""
    tokens = spark.createDataFrame([("click",), ("view",), ("err",)], "token string")
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return e.join(F.broadcast(tokens), F.contains("event_type", "token")).select("event_id", "token").distinct()


def scope_collisions(spark, sf_dir):
    """Customers of a nation whose scopes (segment, or segment/digit) are equal or one within the other, with the shorter scope."""
    scope = F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise(F.concat_ws("/", "c_mktsegment", F.col("c_custkey") % 10))
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("nationkey"), F.col("c_custkey").cast("long").alias("custkey"), scope.alias("scope"))
    return policy.scope_collisions(c, "nationkey", "custkey", "scope")


def contract_eval(spark, sf_dir):
    """Requirements that a lane's evidence lacks, and whether its level reaches the required one."""
    i = F.col("event_id")
    missing = F.array_compact(F.array(F.when(i % 2 == 0, "tests"), F.when(i % 3 == 0, "review"), F.when(i % 5 == 0, "freshness")))
    return lane_events(spark, sf_dir).select("event_id", ((F.size(missing) == 0) & (F.col("data") >= 2)).alias("satisfied"), F.array_join(missing, ",").alias("missing"))


def freshness_policy(spark, sf_dir):
    ahead, behind = F.col("event_id") % 3, F.col("data")
    state = F.when(behind == 0, "fresh").when(ahead > 0, "diverged").otherwise("stale")
    action = F.when(state == "fresh", "none").when(state == "diverged", "block").otherwise("rebase")
    return lane_events(spark, sf_dir).select("event_id", state.alias("state"), action.alias("action"))


def health_rollup(spark, sf_dir):
    g = lane_events(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("n"), F.count_if(F.col("event") == "failed").alias("failed"), F.count_if(F.col("event") == "reconciled").alias("degraded"))
    return g.select("lane", F.when(F.col("failed") == F.col("n"), "failed").when(F.col("failed") + F.col("degraded") > 0, "degraded").otherwise("healthy").alias("health"))


def completion_class(spark, sf_dir):
    reason = F.when(F.col("event_id") % 4 == 0, "unknown").when(F.col("event_id") % 4 == 1, "error").otherwise("stop")
    return lane_events(spark, sf_dir).select("event_id", F.when(((reason == "unknown") & (F.col("data") == 0)) | (reason == "error"), "provider_failure").otherwise("finished").alias("outcome"))


def todo_rollup(spark, sf_dir):
    """Lanes' events as items: empty once all are finished; a nudge if three or more are done and none verifies."""
    g = lane_events(spark, sf_dir).groupBy("lane").agg(F.count("*").alias("n"), F.count_if(F.col("event") == "finished").alias("done"), F.max(F.col("provenance") == "healthcheck").alias("verifies"))
    return g.select("lane", F.when(F.col("done") == F.col("n"), 0).otherwise(F.col("n")).alias("stored"), ((F.col("done") >= 3) & ~F.col("verifies")).alias("nudge"))


def enrich(spark, sf_dir):
    """Later non-null fields override earlier ones."""
    e = lane_events(spark, sf_dir)
    return e.groupBy("lane").agg(F.max_by("environment", F.when(F.col("environment").isNotNull(), F.col("event_id"))).alias("environment"), F.max_by("confidence", F.when(F.col("confidence").isNotNull(), F.col("event_id"))).alias("confidence"))


def fork_lineage(spark, sf_dir):
    """Each lane with its parent (half its number) and grandparent, where those exist."""
    lanes = lane_events(spark, sf_dir).select("lane").distinct()
    l, p, g = lanes.alias("l"), lanes.alias("p"), lanes.alias("g")
    j = l.join(p, F.col("p.lane") == F.floor(F.col("l.lane") / 2), "left").join(g, F.col("g.lane") == F.floor(F.col("p.lane") / 2), "left")
    return j.select(F.col("l.lane").alias("lane"), F.col("p.lane").alias("parent"), F.col("g.lane").alias("grandparent"))


def sequence_check(spark, sf_dir):
    """Errors of a lane's sequence: numbers that do not grow, and empty required fields, with the place."""
    w = W.partitionBy("lane").orderBy("ts", "event_id")
    e = lane_events(spark, sf_dir).withColumns({"was": F.lag("event_id").over(w), "i": F.row_number().over(w) - 1})
    errors = F.array_compact(F.array(F.when(F.col("event_id") <= F.col("was"), F.concat(F.lit("/events/"), "i", F.lit("/seq"))), F.when(F.col("environment").isNull(), F.concat(F.lit("/events/"), "i", F.lit("/environment")))))
    return e.select("lane", "event_id", F.explode(errors).alias("error"))


def shadowing(spark, sf_dir):
    """Names within roots: the earlier root wins, later rows are shadowed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lower(F.concat_ws("-", "c_mktsegment", F.col("c_custkey") % 50)).alias("name"), F.col("c_nationkey").alias("root"))
    r = F.row_number().over(W.partitionBy("name").orderBy("root", "c_custkey"))
    return c.select("c_custkey", "name", (r > 1).alias("shadowed"))


def backoff_schedule(spark, sf_dir):
    return spark.range(1, 13).select(F.col("id").alias("attempt"), F.least(F.lit(200) * F.pow(F.lit(2.0), F.col("id") - 1), F.lit(2000.0)).alias("delay_ms"))


def freshness(spark, sf_dir):
    age = F.col("event_id") % 1000
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 13 == 0, "transport_dead").when(age > 600, "stalled").otherwise("healthy").alias("freshness"))


def access_stats(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("access_count"), F.max("ts").cast("string").alias("last_access"))


def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


def map_lookup(spark, sf_dir):
    m = F.map_concat(F.create_map(F.lit("type"), "event_type"), F.create_map(F.lit("lane"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", F.try_element_at(m, F.lit("lane")).alias("lane"), F.try_element_at(m, F.lit("none")).alias("missing"))


def heading_path(spark, sf_dir):
    """A section's path: the last heading of each lower level (level: event_id modulo 3 plus 1) in its lane."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 3 + 1).alias("level"))
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    last = {k: F.max(F.when(F.col("level") == k, F.col("event_id"))).over(w) for k in (1, 2, 3)}
    e = e.withColumns({f"h{k}": v for k, v in last.items()})
    two = F.when((F.col("level") >= 2) & (F.col("h2") > F.coalesce("h1", F.lit(-1))), F.col("h2"))
    three = F.when(F.col("level") == 3, F.col("h3"))
    return e.select("event_id", F.concat_ws("/", "h1", two, three).alias("path"))


def config_merge(spark, sf_dir):
    """Settings (nation and key) of three files by precedence: the last one wins, key by key."""
    c = table(spark, sf_dir, "customer").select("c_nationkey", F.concat_ws(".", "c_mktsegment", F.col("c_custkey") % 4).alias("path"), (F.col("c_custkey") % 3).alias("precedence"), "c_custkey")
    return c.groupBy("c_nationkey", "path").agg(F.max_by("c_custkey", F.struct("precedence", "c_custkey")).alias("value"))


QUERIES = {
    "filter_provenance": (filter_provenance, f"SELECT event_id, lane FROM {_L} WHERE provenance = 'replay'"),
    "filter_environment": (filter_environment, f"SELECT event_id, lane FROM {_L} WHERE environment = 'prod'"),
    "filter_confidence": (filter_confidence, f"SELECT event_id, confidence FROM {_L} WHERE confidence IN ('high', 'medium')"),
    "live_only": (live_only, f"SELECT event_id, provenance FROM {_L} WHERE provenance NOT IN ('test', 'healthcheck', 'replay')"),
    "terminality": (terminality, f"SELECT event_id, CASE WHEN {_T} THEN 'terminal' WHEN event = 'reconciled' THEN 'uncertainty' ELSE 'advisory' END AS terminality FROM {_L}"),
    "material_change": (material_change, f"SELECT event_id, event IS DISTINCT FROM lag(event) OVER w OR status IS DISTINCT FROM lag(status) OVER w OR data IS DISTINCT FROM lag(data) OVER w AS differs FROM {_L} WINDOW w AS (PARTITION BY lane ORDER BY event_id)"),
    "task_list": (task_list, f"SELECT event_id, lane FROM {_L} WHERE status = 'green' ORDER BY event_id"),
    "dedupe_commits": (dedupe_commits, f"""
        SELECT event_id, commit FROM (SELECT *, row_number() OVER (PARTITION BY commit ORDER BY event_id DESC) AS r FROM (SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN lane || '-' || data END AS commit FROM {_L} WHERE event_id % 13 <> 0)) WHERE commit IS NULL OR r = 1"""),
    "dedupe_terminal": (dedupe_terminal, f"SELECT event_id, event FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint, {_T} ORDER BY event_id) AS r FROM {_L}) WHERE NOT ({_T}) OR r = 1"),
    "reconcile_terminal": (reconcile_terminal, f"""
        SELECT lane, seq, CASE WHEN doubt > first THEN 'reconciled' ELSE event END AS event FROM (
          SELECT lane, min(event_id) FILTER ({_T}) AS first, arg_max(event, event_id) FILTER ({_T}) AS event, max(event_id) FILTER ({_T}) AS seq, max(event_id) FILTER (event = 'reconciled') AS doubt FROM {_L} GROUP BY lane) WHERE first IS NOT NULL"""),
    "nudge_class": (nudge_class, f"""
        SELECT event_id, CASE WHEN over_ = 1 THEN 'stale' WHEN seen > 0 THEN 'retry' ELSE 'new' END AS nudge FROM (
          SELECT *, max(CASE WHEN event = 'finished' THEN 1 END) OVER (PARTITION BY lane ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS over_, row_number() OVER (PARTITION BY fingerprint ORDER BY event_id) - 1 AS seen FROM {_L}) WHERE event = 'progress'"""),
    "lane_board": (lane_board, f"""
        WITH g AS (SELECT lane, max(ts) AS seen, arg_max(event, event_id) AS event FROM {_L} GROUP BY lane), h AS (SELECT *, epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', seen)) AS age FROM g)
        SELECT CASE WHEN {_T} THEN 'finished' WHEN event = 'reconciled' THEN 'blocked' ELSE 'active' END AS state, CASE WHEN age > 86400 THEN 'stalled' WHEN age > 7200 THEN 'quiet' ELSE 'fresh' END AS freshness, count(*) AS n FROM h GROUP BY ALL"""),
    "counts_by_key": (counts_by_key, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY event_type"),
    "distinct_ordered": (distinct_ordered, f"SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY min(event_id)) AS rank, data FROM {_L} GROUP BY lane, data"),
    "duplicate_ids": (duplicate_ids, f"SELECT fingerprint, count(*) AS n FROM {_L} GROUP BY fingerprint HAVING count(*) > 1"),
    "recovery_ledger": (recovery_ledger, f"""
        SELECT event_id, attempt, ['restart', 'rebase', 'retry', 'clean', 'rerun', 'reauth', 'wait'][data + 1] AS step, CASE WHEN attempt > 1 THEN 'escalate' ELSE 'attempt' END AS outcome
        FROM (SELECT *, row_number() OVER (PARTITION BY lane, data ORDER BY event_id) AS attempt FROM {_L} WHERE event = 'failed')"""),
    "fingerprint": (fingerprint, f"SELECT event_id, fingerprint FROM {_L}"),
    "report_hash": (report_hash, f"SELECT lane, sha256(array_to_string(list_sort(list(event || ':' || status || ':' || data)), ',')) AS report_hash FROM {_L} GROUP BY lane"),
    "report_projection": (report_projection, f"SELECT event_id, CASE WHEN event_id % 4 <= 1 THEN event || ' ' || status ELSE '<redacted>' END AS text, CASE WHEN event_id % 4 > 1 THEN sha256(event || ' ' || status) END AS original_hash FROM {_L} WHERE event_id % 4 < 3"),
    "validate_rows": (validate_rows, f"""
        SELECT event_id, array_to_string(e, '; ') AS errors, len(e) AS n_errors FROM (SELECT event_id, list_filter([CASE WHEN environment IS NULL THEN 'environment: missing' END, CASE WHEN confidence IS NULL THEN 'confidence: missing' END, CASE WHEN data > 5 THEN 'data: too large' END], lambda x: x IS NOT NULL) AS e FROM {_L})"""),
    "board_validate": (board_validate, f"SELECT event_id, count(*) OVER (PARTITION BY fingerprint) > 1 AS repeated, status <> 'green' AS bad_status FROM {_L}"),
    "path_scope": (path_scope, "SELECT doc_id, doc_id % 5 <> 0 AND doc_id % 3 <> 0 AS allowed FROM documents"),
    "rule_match": (rule_match, f"""
        WITH r(ordinal, decision, tool, kind, subject) AS (VALUES {', '.join(map(repr, _RULES))}), e AS (SELECT event_id, event_type, floor(value)::BIGINT::VARCHAR AS v FROM events)
        SELECT event_id, min(ordinal)::BIGINT AS ordinal, arg_min(decision, ordinal) AS decision FROM e JOIN r ON event_type = tool AND (kind = 'any' OR kind = 'exact' AND v = subject OR kind = 'prefix' AND starts_with(v, subject)) GROUP BY event_id"""),
    "authz_decision": (authz_decision, """
        SELECT event_id, CASE WHEN event_type = 'error' OR event_id % 17 = 0 OR event_id % 10 = 0 THEN 'deny' WHEN event_id % 10 = 1 OR event_id % 9 = 0 THEN 'prompt' WHEN event_id % 8 = 0 OR event_id % 4 >= user_id % 3 THEN 'allow'
          WHEN event_id % 4 = 1 AND user_id % 3 = 2 THEN 'prompt' ELSE 'deny' END AS decision FROM events"""),
    "grant_validation": (grant_validation, """
        SELECT event_id, CASE WHEN s <> 'granted' THEN 'status_' || s WHEN value > 90 THEN 'expired' WHEN event_id % 4 >= 3 THEN 'already_consumed' WHEN event_id % 5 = 0 THEN 'scope_mismatch' WHEN event_id % 7 = 0 THEN 'unauthorized_delegate' ELSE 'valid' END AS outcome
        FROM (SELECT *, ['granted', 'granted', 'pending', 'consumed', 'expired', 'revoked'][event_id % 6 + 1] AS s FROM events)"""),
    "policy_actions": (policy_actions, f"""
        WITH r(priority, ordinal, action, completed, green, min_failures) AS (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in p) + ')' for p in _POLICIES)}),
        c AS (SELECT lane, bool_or(event = 'finished') AS done, arg_max(status = 'green', event_id) AS is_green, count(*) FILTER (event = 'failed') AS failures FROM {_L} GROUP BY lane)
        SELECT lane, row_number() OVER (PARTITION BY lane ORDER BY priority, ordinal) AS rank, action FROM c JOIN r ON (completed IS NULL OR completed = done) AND (green IS NULL OR green = is_green) AND (min_failures IS NULL OR failures >= min_failures)"""),
    "lane_completion": (lane_completion, f"SELECT lane, 'closeout' AS action FROM {_L} GROUP BY lane HAVING bool_or(event = 'finished') AND arg_max(status, event_id) = 'green' AND arg_max(event, event_id) <> 'failed'"),
    "substring_join": (substring_join, "SELECT DISTINCT event_id, token FROM events JOIN (VALUES ('click'), ('view'), ('err')) t(token) ON contains(event_type, token)"),
    "scope_collisions": (scope_collisions, """
        WITH s AS (SELECT c_nationkey AS g, c_custkey AS o, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_mktsegment || '/' || (c_custkey % 10) END AS scope FROM customer),
        pairs AS (SELECT a.g, a.o, b.o AS other, CASE WHEN length(a.scope) <= length(b.scope) THEN a.scope ELSE b.scope END AS scope FROM s a JOIN s b
          ON a.g = b.g AND a.o <> b.o AND (a.scope = b.scope OR starts_with(a.scope, b.scope || '/') OR starts_with(b.scope, a.scope || '/')))
        SELECT g::BIGINT AS nationkey, o::BIGINT AS custkey, scope, count(DISTINCT other)::BIGINT AS others FROM pairs GROUP BY ALL"""),
    "contract_eval": (contract_eval, f"""
        SELECT event_id, len(m) = 0 AND data >= 2 AS satisfied, array_to_string(m, ',') AS missing FROM (SELECT *, list_filter([CASE WHEN event_id % 2 = 0 THEN 'tests' END, CASE WHEN event_id % 3 = 0 THEN 'review' END, CASE WHEN event_id % 5 = 0 THEN 'freshness' END], lambda x: x IS NOT NULL) AS m FROM {_L})"""),
    "freshness_policy": (freshness_policy, f"SELECT event_id, CASE WHEN data = 0 THEN 'fresh' WHEN event_id % 3 > 0 THEN 'diverged' ELSE 'stale' END AS state, CASE WHEN data = 0 THEN 'none' WHEN event_id % 3 > 0 THEN 'block' ELSE 'rebase' END AS action FROM {_L}"),
    "health_rollup": (health_rollup, f"SELECT lane, CASE WHEN bool_and(event = 'failed') THEN 'failed' WHEN bool_or(event IN ('failed', 'reconciled')) THEN 'degraded' ELSE 'healthy' END AS health FROM {_L} GROUP BY lane"),
    "completion_class": (completion_class, f"SELECT event_id, CASE WHEN event_id % 4 = 0 AND data = 0 OR event_id % 4 = 1 THEN 'provider_failure' ELSE 'finished' END AS outcome FROM {_L}"),
    "todo_rollup": (todo_rollup, f"SELECT lane, CASE WHEN bool_and(event = 'finished') THEN 0 ELSE count(*) END AS stored, count(*) FILTER (event = 'finished') >= 3 AND NOT bool_or(provenance = 'healthcheck') AS nudge FROM {_L} GROUP BY lane"),
    "enrich": (enrich, f"SELECT lane, arg_max(environment, event_id) FILTER (environment IS NOT NULL) AS environment, arg_max(confidence, event_id) FILTER (confidence IS NOT NULL) AS confidence FROM {_L} GROUP BY lane"),
    "fork_lineage": (fork_lineage, f"WITH l AS (SELECT DISTINCT lane FROM {_L}) SELECT l.lane, p.lane AS parent, g.lane AS grandparent FROM l LEFT JOIN l p ON p.lane = l.lane // 2 LEFT JOIN l g ON g.lane = p.lane // 2"),
    "sequence_check": (sequence_check, f"""
        SELECT lane, event_id, unnest(list_filter([CASE WHEN event_id <= was THEN '/events/' || i || '/seq' END, CASE WHEN environment IS NULL THEN '/events/' || i || '/environment' END], lambda x: x IS NOT NULL)) AS error
        FROM (SELECT *, lag(event_id) OVER w AS was, row_number() OVER w - 1 AS i FROM {_L} WINDOW w AS (PARTITION BY lane ORDER BY ts, event_id))"""),
    "shadowing": (shadowing, "SELECT c_custkey, name, row_number() OVER (PARTITION BY name ORDER BY c_nationkey, c_custkey) > 1 AS shadowed FROM (SELECT *, lower(c_mktsegment || '-' || (c_custkey % 50)) AS name FROM customer)"),
    "backoff_schedule": (backoff_schedule, "SELECT attempt, least(200 * pow(2.0, attempt - 1), 2000.0) AS delay_ms FROM (SELECT unnest(range(1, 13)) AS attempt)"),
    "freshness": (freshness, "SELECT event_id, CASE WHEN event_id % 13 = 0 THEN 'transport_dead' WHEN event_id % 1000 > 600 THEN 'stalled' ELSE 'healthy' END AS freshness FROM events"),
    "access_stats": (access_stats, "SELECT user_id, count(*) AS access_count, max(ts)::VARCHAR AS last_access FROM events GROUP BY user_id"),
    "json_extract": (json_extract, "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events"),
    "map_lookup": (map_lookup, "SELECT event_id, user_id::VARCHAR AS lane, NULL::VARCHAR AS missing FROM events"),
    "heading_path": (heading_path, """
        SELECT event_id, concat_ws('/', h1, CASE WHEN level >= 2 AND h2 > coalesce(h1, -1) THEN h2 END, CASE WHEN level = 3 THEN h3 END) AS path FROM (
          SELECT *, max(CASE WHEN level = 1 THEN event_id END) OVER w AS h1, max(CASE WHEN level = 2 THEN event_id END) OVER w AS h2, max(CASE WHEN level = 3 THEN event_id END) OVER w AS h3
          FROM (SELECT *, event_id % 3 + 1 AS level FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"""),
    "config_merge": (config_merge, "SELECT c_nationkey::BIGINT AS c_nationkey, c_mktsegment || '.' || (c_custkey % 4) AS path, arg_max(c_custkey, (c_custkey % 3) * 1000000000000 + c_custkey) AS value FROM customer GROUP BY ALL"),
}
