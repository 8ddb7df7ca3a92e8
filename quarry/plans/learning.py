"""Metrics, graph and learning: an order is a session, its parts the items, a fulfilled order a success."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import learning as L
from quarry.operators.common import spread, written
from quarry.plans.common import table


def _access(spark, sf_dir):
    """Sessions' items, dealt by session to tasks of a bounded number of rows; pairs need no further shuffle of them."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session"), (F.col("o_orderstatus") == "F").alias("ok"))
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session"), (F.col("l_partkey") % 200).alias("item"))
    n = spread(o.count() + l.count(), spark)
    return l.repartition(n, "session").join(o.repartition(n, "session").hint("shuffle_hash"), "session")


_ACCESS = "(SELECT DISTINCT l_orderkey AS session, l_partkey % 200 AS item, o_orderstatus = 'F' AS ok FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_PAIRS = f"(SELECT x.session, x.ok, x.item AS a, y.item AS b, n FROM {_ACCESS} x JOIN {_ACCESS} y ON x.session = y.session AND x.item < y.item JOIN (SELECT session, count(*) AS n FROM {_ACCESS} GROUP BY session) s ON x.session = s.session)"
_EDGES = f"(SELECT a, b, 0.5 + sum(CASE WHEN ok THEN 0.1 * ln(1 + n / 2) ELSE 0 END) AS alpha, 1.5 + sum(CASE WHEN ok THEN 0 ELSE 0.1 * ln(1 + n / 2) END) AS beta FROM {_PAIRS} GROUP BY a, b)"
_WEIGHT = "greatest(0.001, least(0.999, alpha / (alpha + beta)))"
_CONFIDENCE = "greatest(0.0, least(1.0, 1 - 4 * (alpha * beta) / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1))))"


def coaccess_pairs(spark, sf_dir):
    return L.coaccess_pairs(_access(spark, sf_dir)).groupBy("a", "b").agg(F.count("*").alias("sessions"))


def hebbian_edges(spark, sf_dir):
    return L.hebbian_edges(_access(spark, sf_dir)).select("a", "b", *[F.round(c, 6).alias(c) for c in ("alpha", "beta", "weight", "confidence")])


def edge_traversals(spark, sf_dir):
    """Edges between neighbouring items, and in how many sessions both ends were accessed."""
    return L.coaccess_pairs(_access(spark, sf_dir)).where("b = a + 1").groupBy("a", "b").agg(F.count("*").alias("traversals"), F.count_if("ok").alias("successes"))


def _rewards(spark, sf_dir):
    e = edge_traversals(spark, sf_dir)
    return e.select("a", "b", (F.col("a") % 7).alias("kind"), (F.col("successes") / F.col("traversals")).alias("reward"))


_TRAVERSED = f"(SELECT a, b, count(*) AS traversals, count(*) FILTER (ok) AS successes FROM {_PAIRS} WHERE b = a + 1 GROUP BY a, b)"
_REWARDS = f"(SELECT a, b, a % 7 AS kind, successes / traversals AS reward FROM {_TRAVERSED})"
_ADVANTAGE = f"(SELECT *, CASE WHEN count(*) OVER w = 1 THEN CASE WHEN reward > 0.5 THEN 0.5 ELSE -0.5 END ELSE (reward - avg(reward) OVER w) / greatest(stddev_pop(reward) OVER w, 1e-8) END AS advantage FROM {_REWARDS} WINDOW w AS (PARTITION BY kind))"


def edge_reward(spark, sf_dir):
    return _rewards(spark, sf_dir).select("a", "b", F.round("reward", 6).alias("reward"))


def grpo_advantage(spark, sf_dir):
    return L.advantages(_rewards(spark, sf_dir)).select("a", "b", F.round("advantage", 6).alias("advantage"))


def grpo_step(spark, sf_dir):
    """One step: rewards, advantages in their kind, clipped exponential update of weight 1, confidence from one update of five."""
    a = L.advantages(_rewards(spark, sf_dir))
    return a.select("a", "b", F.round(L.clipped_update(F.lit(1.0), F.col("advantage")), 6).alias("weight"), F.lit(0.2).alias("confidence"))


def grpo_update(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(L.clipped_update(F.col("p_size") / 10.0, F.col("p_retailprice") - 1200, 0.001), 6).alias("weight"))


def _posterior(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.lit(0.5) + F.col("p_size") / 7.0).alias("alpha"), (F.lit(1.5) + F.col("p_partkey") % 11).alias("beta"))


_POSTERIOR = "(SELECT p_partkey, 0.5 + p_size / 7.0 AS alpha, 1.5::DOUBLE + p_partkey % 11 AS beta FROM part)"


def beta_posterior(spark, sf_dir):
    a, b = F.col("alpha"), F.col("beta")
    return _posterior(spark, sf_dir).select("p_partkey", F.round(L.beta_weight(a, b), 6).alias("weight"), F.round(L.beta_confidence(a, b), 6).alias("confidence"))


def beta_entropy(spark, sf_dir):
    return _posterior(spark, sf_dir).select("p_partkey", F.round(L.beta_entropy(F.col("alpha"), F.col("beta")), 6).alias("entropy"))


def _digamma_sql(x):
    low = " ".join(f"- CASE WHEN {x} < 6 THEN 1 / ({x} + {i}) ELSE 0 END" for i in range(6))
    z = f"(CASE WHEN {x} < 6 THEN {x} + 6 ELSE {x} END)"
    return f"(0.0 {low} + ln{z} - 1 / (2 * {z}) - 1 / (12 * {z} * {z}) + 1 / (120 * {z} * {z} * {z} * {z}))"


def _ln_gamma_sql(x):
    low = " ".join(f"- CASE WHEN {x} < 6 THEN ln({x} + {i}) ELSE 0 END" for i in range(6))
    z = f"(CASE WHEN {x} < 6 THEN {x} + 6 ELSE {x} END)"
    return f"(({z} - 0.5) * ln{z} - {z} + 0.9189385332046727 + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) {low})"


def gram_score(spark, sf_dir):
    """Mean of weight * confidence over the edges that a session's items touch; here by first item."""
    e = L.hebbian_edges(_access(spark, sf_dir))
    return e.groupBy("a").agg(F.round(F.coalesce(F.avg(F.col("weight") * F.col("confidence")), F.lit(0.0)), 6).alias("score"))


def gram_mode(spark, sf_dir):
    """Rolling mean of the last 20 scores of a user's events: shadow below 10 of them, canary below 0.3, else mature.

    Means of 16 scores may end in a 5 at the seventh place: they are scaled and rounded as doubles, as the SQL does, not by their decimal digits.
    """
    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(-19, 0)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.avg(F.col("value") / 150.0).over(w).alias("m"), F.count("*").over(w).alias("n"))
    return e.select("event_id", (F.round(F.col("m") * 1e6) / 1e6).alias("rolling"), F.when(F.col("n") < 10, "shadow").when(F.col("m") < 0.3, "canary").otherwise("mature").alias("mode"))


def stat_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.median("value"), 6).alias("median"), F.round(F.stddev_pop("value"), 6).alias("std"), F.count("value").alias("n"))


def metric_summary(spark, sf_dir):
    """Statistics without the missing values (a value below 10 counts as one), null where all are."""
    v = F.when(F.col("value") >= 10, F.col("value"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg(v), 6).alias("mean"), F.count(v).alias("n"))


def _retrieved(spark, sf_dir):
    """A query a source: its documents; those of quality 1 are golden."""
    best = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    d = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars").join(best, "doc_id", "left")
    return d.select("source", "doc_id", "n_chars", F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("golden"))


def _golden_at(ranked, order, k=5):
    """(source, hits, n): of the first k by an order how many are golden, and how many there are; no task holds more of a source than it must rank."""
    w = W.partitionBy("source").orderBy(*order)
    return ranked.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).groupBy("source").agg(F.sum("golden").alias("hits"), F.count("*").alias("n"))


def _recall(ranked, order, k=5):
    golden = ranked.groupBy("source").agg(F.sum("golden").alias("all"))
    return golden.join(_golden_at(ranked, order, k), "source").select("source", F.round(F.when(F.col("all") > 0, F.col("hits") / F.col("all")).otherwise(0.0), 6).alias("recall"))


_BY_LENGTH, _FROM_END, _BY_ID = ("-n_chars", "doc_id"), ("n_chars", "-doc_id"), ("doc_id",)


def _order(names):
    return [F.desc(n[1:]) if n.startswith("-") else F.asc(n) for n in names]


_RUNS = """(SELECT source, list(d.doc_id ORDER BY n_chars DESC, d.doc_id) AS retrieved, list(d.doc_id ORDER BY d.doc_id) AS plain, list(d.doc_id) FILTER (quality = 1) AS golden FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id GROUP BY source)"""


def recall_at_k(spark, sf_dir):
    return _recall(_retrieved(spark, sf_dir), _order(_BY_LENGTH))


def coverage(spark, sf_dir):
    """The share of the last five retrieved that is golden."""
    last = _golden_at(_retrieved(spark, sf_dir), _order(_FROM_END))
    return last.where("n = 5").select("source", F.round(F.col("hits") / 5, 6).alias("coverage"))


def step_reduction(spark, sf_dir):
    d, g = F.col("event_id") % 30, F.col("user_id") % 12
    return table(spark, sf_dir, "events").select("event_id", F.round(F.when((d > 0) & (g > 0), F.greatest(F.lit(0.0), (d - g) / d)), 6).alias("reduction"))


def _two(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    a = e.where("event_type = 'click'").groupBy("user_id").agg(F.avg("value").alias("a"))
    b = e.where("event_type = 'view'").groupBy("user_id").agg(F.avg("value").alias("b"))
    return a.join(b, "user_id").withColumn("delta", F.col("b") - F.col("a"))


_TWO = "(SELECT a.user_id, b - a AS delta FROM (SELECT user_id, avg(value) AS a FROM events WHERE event_type = 'click' GROUP BY user_id) a JOIN (SELECT user_id, avg(value) AS b FROM events WHERE event_type = 'view' GROUP BY user_id) b ON a.user_id = b.user_id)"


def paired_deltas(spark, sf_dir):
    return _two(spark, sf_dir).select("user_id", F.round("delta", 6).alias("delta"))


def bootstrap_ci(spark, sf_dir, resamples: int = 1000):
    """Paired bootstrap of the mean delta at 95 per cent: draw j of resample r is pair md5("r,j") (its first 60 bits) modulo n, with replacement and the same anywhere."""
    return L.bootstrap_interval(_two(spark, sf_dir).select("user_id", "delta"), "user_id", "delta", resamples).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def eval_run(spark, sf_dir):
    """The ranking by length against that by number, over all sources but synthetic ones (here src0): a row a metric with its statistics, and the interval of the paired change in recall."""
    ranked = _retrieved(spark, sf_dir).where("source <> 'src0'")
    one = _recall(ranked, _order(_BY_LENGTH))
    two = _recall(ranked, _order(_BY_ID)).withColumnRenamed("recall", "plain")
    last = _golden_at(ranked, _order(_FROM_END)).where("n = 5").select("source", F.round(F.col("hits") / 5, 6).alias("coverage"))
    runs = written(one.join(two, "source").join(last, "source", "left").withColumn("change", F.round(F.col("recall") - F.col("plain"), 6)), "runs")
    interval = L.bootstrap_interval(runs.select("source", "change"), "source", "change").withColumn("metric", F.lit("change"))  # one row
    long = runs.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("x")) for m in ("recall", "coverage", "change")])))
    stats = long.groupBy("metric").agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.median("x"), 6).alias("median"), F.round(F.stddev_pop("x"), 6).alias("std"), F.count("x").alias("n"))
    return stats.join(F.broadcast(interval), "metric", "left").select("metric", "mean", "median", "std", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


#: Sources whose documents are for evaluation.
EVALUATION = ("src0", "src1", "src2", "src3")


def disjoint_split(spark, sf_dir):
    """Training documents: all of sources that no evaluation document has."""
    d = table(spark, sf_dir, "documents")
    held = d.where(F.col("source").isin(*EVALUATION)).select("source").distinct()
    return d.join(held, "source", "left_anti").select("doc_id", "source")


def _graph(spark, sf_dir):
    """Customers' orders between nations and parts' brands: weighted edges both ways."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("n"), "c_nationkey").alias("n"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("b"))
    e = table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    g = e.groupBy("n", "b").agg(F.count("*").cast("double").alias("weight"))
    return g.select(F.col("n").alias("source"), F.col("b").alias("target"), "weight", F.lit(0.5).alias("confidence"))


def ppr(spark, sf_dir):
    """PageRank from nation 1's node; brands have no way out, so their rank returns to the seed."""
    e = _graph(spark, sf_dir)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    seeds = spark.createDataFrame([("n1",)], "node string")
    return G.personalized_pagerank(e, nodes, seeds).select("node", F.round("rank", 6).alias("rank"))


_G = "(SELECT 'n' || c_nationkey AS source, p_brand AS target, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY ALL)"


def _ppr_ctes(edges, nodes, seeds, rounds=20):
    """The rounds of PageRank as r0, r1, ...: edges (source, target, weight), nodes (node) and seeds (node)."""
    ctes = f"e AS MATERIALIZED (SELECT source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM {edges}), seeds AS ({seeds}), nodes AS ({nodes}), start AS (SELECT node, CASE WHEN node IN (SELECT node FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0.0 END AS p FROM nodes), r0 AS (SELECT node, p AS rank FROM start)"
    for i in range(rounds):
        ctes += f""", r{i + 1} AS MATERIALIZED (SELECT n.node, (0.15 + (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node NOT IN (SELECT source FROM e))) * n.p + 0.85 * coalesce(f.flow, 0) AS rank
          FROM start n LEFT JOIN (SELECT target, sum(rank * share) AS flow FROM r{i} JOIN e ON node = source GROUP BY target) f ON n.node = f.target)"""
    return ctes


_PPR = f"WITH {_ppr_ctes(_G, 'SELECT source AS node FROM e UNION SELECT target FROM e', 'SELECT chr(110) || 1 AS node')} SELECT node, round(rank, 6) AS rank FROM r20 WHERE rank > 0"


def _code_nodes(spark, sf_dir):
    """Every vector as a node: two of three are functions or classes, two neighbouring ones lie in one document."""
    kind = F.element_at(F.array(F.lit("function"), F.lit("class"), F.lit("module")), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node"), kind.alias("kind"), F.floor(F.col("vec_id") / 2).alias("file"), "embedding")


def ppr_seeds(spark, sf_dir):
    """The three functions or classes nearest to vec_id 0."""
    query = table(spark, sf_dir, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))  # one row
    found = G.ppr_seeds(_code_nodes(spark, sf_dir).crossJoin(F.broadcast(query)), F.col("q"))
    return found.select("node", F.round("score", 6).alias("score"))


def candidates_ppr(spark, sf_dir):
    """Documents of the nodes that PageRank reaches from those seeds, over edges to the next node (weight 2) and to the half."""
    nodes = _code_nodes(spark, sf_dir)
    ids = nodes.select(F.col("node").alias("source"))
    after = ids.join(ids.select(F.col("source").alias("target")), F.col("target") == F.col("source") + 1).withColumn("weight", F.lit(2.0))
    edges = after.unionByName(ids.select("source", F.floor(F.col("source") / 2).alias("target"), F.lit(1.0).alias("weight"))).withColumn("confidence", F.lit(0.5))
    rank = G.personalized_pagerank(edges, ids.select(F.col("source").alias("node")), ppr_seeds(spark, sf_dir).select("node"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk"), F.col("doc_id").alias("path"))
    return G.candidates_ppr(rank.select("node", F.round("rank", 9).alias("rank")), nodes.select("node", "file"), chunks)


_SEEDS = "SELECT e.vec_id AS node, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id % 3 < 2 ORDER BY score DESC, node LIMIT 3"
_NEXT = "(SELECT a.vec_id AS source, b.vec_id AS target, 2.0::DOUBLE AS weight FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 UNION ALL SELECT vec_id, vec_id // 2, 1.0 FROM embeddings)"
_CANDIDATES = f"""WITH {_ppr_ctes(_NEXT, 'SELECT vec_id AS node FROM embeddings', _SEEDS)}, best AS (SELECT node, row_number() OVER (ORDER BY round(rank, 9) DESC, node) AS pos FROM r20 WHERE rank > 0)
        SELECT doc_id AS chunk, min(pos) AS pos FROM best JOIN documents ON doc_id = node // 2 WHERE pos <= 100 GROUP BY doc_id"""


def nodes_by_kind(spark, sf_dir):
    e = _graph(spark, sf_dir)
    n = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return n.groupBy(F.when(F.startswith("node", F.lit("n")), "nation").otherwise("brand").alias("kind")).agg(F.count("*").alias("n"))


def neighbors(spark, sf_dir):
    """Edges both of whose ends exist, from one node."""
    o, c = table(spark, sf_dir, "orders").alias("o"), table(spark, sf_dir, "customer").alias("c")
    return o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey")).where("c_nationkey = 3").select("o_orderkey", "c_custkey")


def edge_lookup(spark, sf_dir):
    """An undirected edge has one place, whichever end comes first."""
    o = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 50).alias("x"), (F.col("l_suppkey") % 50).alias("y")).where("x <> y")
    return o.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("n"))


_CODE = "import os\nfrom a.b import c\nclass K:\n    def f(self):\n        return g(1)\ndef g(x):\n    return K()\n"


def _code(spark, sf_dir):
    s = table(spark, sf_dir, "region").select(F.concat(F.lit("m"), "r_regionkey", F.lit(".py")).alias("path"), F.lit(_CODE).alias("text"))
    return G.python_graph(s)


def ast_graph(spark, sf_dir):
    return _code(spark, sf_dir)


def resolve_calls(spark, sf_dir):
    return G.resolve_calls(_code(spark, sf_dir))


QUERIES = {
    "coaccess_pairs": (coaccess_pairs, f"SELECT a, b, count(*) AS sessions FROM {_PAIRS} GROUP BY a, b"),
    "hebbian_edges": (hebbian_edges, f"SELECT a, b, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round({_WEIGHT}, 6) AS weight, round({_CONFIDENCE}, 6) AS confidence FROM {_EDGES}"),
    "edge_traversals": (edge_traversals, f"SELECT * FROM {_TRAVERSED}"),
    "edge_reward": (edge_reward, f"SELECT a, b, round(reward, 6) AS reward FROM {_REWARDS}"),
    "grpo_advantage": (grpo_advantage, f"SELECT a, b, round(advantage, 6) AS advantage FROM {_ADVANTAGE}"),
    "grpo_step": (grpo_step, f"SELECT a, b, round(greatest(0.01, least(100.0, exp(greatest(-0.2, least(0.2, 0.01 * advantage))))), 6) AS weight, 0.2::DOUBLE AS confidence FROM {_ADVANTAGE}"),
    "grpo_update": (grpo_update, "SELECT p_partkey, round(greatest(0.01, least(100.0, p_size / 10.0 * exp(greatest(-0.2, least(0.2, 0.001 * (p_retailprice - 1200)))))), 6) AS weight FROM part"),
    "beta_posterior": (beta_posterior, f"SELECT p_partkey, round({_WEIGHT}, 6) AS weight, round({_CONFIDENCE}, 6) AS confidence FROM {_POSTERIOR}"),
    "beta_entropy": (beta_entropy, f"SELECT p_partkey, round({_ln_gamma_sql('alpha')} + {_ln_gamma_sql('beta')} - {_ln_gamma_sql('ab')} - (alpha - 1) * {_digamma_sql('alpha')} - (beta - 1) * {_digamma_sql('beta')} + (ab - 2) * {_digamma_sql('ab')}, 6) AS entropy FROM (SELECT *, alpha + beta AS ab FROM {_POSTERIOR})"),
    "gram_score": (gram_score, f"SELECT a, round(avg({_WEIGHT} * {_CONFIDENCE}), 6) AS score FROM {_EDGES} GROUP BY a"),
    "gram_mode": (gram_mode, "SELECT event_id, round(m, 6) AS rolling, CASE WHEN n < 10 THEN 'shadow' WHEN m < 0.3 THEN 'canary' ELSE 'mature' END AS mode FROM (SELECT event_id, avg(value / 150.0) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 19 PRECEDING))"),
    "stat_summary": (stat_summary, "SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, count(value) AS n FROM events GROUP BY event_type"),
    "metric_summary": (metric_summary, "SELECT user_id, round(avg(value) FILTER (value >= 10), 6) AS mean, count(*) FILTER (value >= 10) AS n FROM events GROUP BY user_id"),
    "recall_at_k": (recall_at_k, f"SELECT source, round(CASE WHEN len(golden) > 0 THEN len(list_intersect(retrieved[1:5], golden)) / len(golden) ELSE 0 END, 6) AS recall FROM {_RUNS}"),
    "coverage": (coverage, f"SELECT source, round(len(list_filter(retrieved[-5:], lambda x: coalesce(list_contains(golden, x), false))) / 5, 6) AS coverage FROM {_RUNS} WHERE len(retrieved) >= 5"),
    "step_reduction": (step_reduction, "SELECT event_id, round(CASE WHEN event_id % 30 > 0 AND user_id % 12 > 0 THEN greatest(0, (event_id % 30 - user_id % 12) / (event_id % 30)) END, 6) AS reduction FROM events"),
    "paired_deltas": (paired_deltas, f"SELECT user_id, round(delta, 6) AS delta FROM {_TWO}"),
    "bootstrap_ci": (bootstrap_ci, f"""
        WITH t AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS i, delta, count(*) OVER () AS n FROM {_TWO}), d AS (SELECT r, ('0x' || substr(md5(r || ',' || j), 1, 15))::BIGINT % n AS i FROM (SELECT unnest(range(1000)) AS r), (SELECT i AS j, n FROM t)),
        m AS (SELECT avg(delta) AS m FROM d JOIN t ON d.i = t.i GROUP BY r), k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k FROM m) SELECT round(max(m) FILTER (k = 25), 6) AS low, round(max(m) FILTER (k = 975), 6) AS high FROM k"""),
    "eval_run": (eval_run, f"""
        WITH r AS (SELECT source, round(CASE WHEN len(golden) > 0 THEN len(list_intersect(retrieved[1:5], golden)) / len(golden) ELSE 0 END, 6) AS recall, round(CASE WHEN len(golden) > 0 THEN len(list_intersect(plain[1:5], golden)) / len(golden) ELSE 0 END, 6) AS other,
          CASE WHEN len(retrieved) >= 5 THEN round(len(list_filter(retrieved[-5:], lambda x: coalesce(list_contains(golden, x), false))) / 5, 6) END AS coverage FROM {_RUNS} WHERE source <> 'src0'),
        x AS (SELECT source, 'recall' AS metric, recall AS x FROM r UNION ALL SELECT source, 'coverage', coverage FROM r UNION ALL SELECT source, 'change', round(recall - other, 6) FROM r),
        t AS (SELECT row_number() OVER (ORDER BY source) - 1 AS i, x AS delta, count(*) OVER () AS n FROM x WHERE metric = 'change'), d AS (SELECT r, ('0x' || substr(md5(r || ',' || j), 1, 15))::BIGINT % n AS i FROM (SELECT unnest(range(1000)) AS r), (SELECT i AS j, n FROM t)),
        m AS (SELECT avg(delta) AS m FROM d JOIN t ON d.i = t.i GROUP BY r), k AS (SELECT m, row_number() OVER (ORDER BY m) - 1 AS k FROM m), c AS (SELECT max(m) FILTER (k = 25) AS low, max(m) FILTER (k = 975) AS high FROM k)
        SELECT metric, round(avg(x), 6) AS mean, round(median(x), 6) AS median, round(stddev_pop(x), 6) AS std, count(x) AS n, CASE WHEN metric = 'change' THEN round(any_value(low), 6) END AS low, CASE WHEN metric = 'change' THEN round(any_value(high), 6) END AS high FROM x, c GROUP BY metric"""),
    "disjoint_split": (disjoint_split, f"SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.source = d.source AND e.source IN {EVALUATION})"),
    "ppr": (ppr, _PPR),
    "ppr_seeds": (ppr_seeds, f"SELECT node, round(score, 6) AS score FROM ({_SEEDS})"),
    "candidates_ppr": (candidates_ppr, _CANDIDATES),
    "nodes_by_kind": (nodes_by_kind, f"SELECT CASE WHEN starts_with(node, 'n') THEN 'nation' ELSE 'brand' END AS kind, count(*) AS n FROM (SELECT source AS node FROM {_G} UNION SELECT target FROM {_G}) GROUP BY 1"),
    "neighbors": (neighbors, "SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = 3"),
    "edge_lookup": (edge_lookup, "SELECT least(x, y) AS a, greatest(x, y) AS b, count(*) AS n FROM (SELECT l_partkey % 50 AS x, l_suppkey % 50 AS y FROM lineitem) WHERE x <> y GROUP BY ALL"),
    "ast_graph": (ast_graph, None),
    "resolve_calls": (resolve_calls, None),
}
