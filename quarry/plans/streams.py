"""Streaming queries, run to the end of what there is and read from their sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.plans.common import scratch, table
from quarry.plans.events import _L, _T, lane_events
from quarry.streaming import stateful as SF
from quarry.streaming import streams as S


def _source(spark, df, name):
    """df as a stream of files."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(path)


def _drain(spark, df, name, mode="append"):
    """All rows that a stream gives, in a folder with one part a batch; later batches' rows have larger numbers."""
    out = scratch(spark, name)

    def put(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/written={number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", scratch(spark, f"{name}-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


def stream_windowed_counts(spark, sf_dir):
    """Tumbling days: batch and stream give the same rows for the windows that the watermark closes."""
    e = _source(spark, table(spark, sf_dir, "events"), "events")
    got = _drain(spark, S.windowed_counts(e), "windows")
    return got.select(F.col("window.start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_dedupe(spark, sf_dir):
    """Fingerprints that passed, counted: each once as the watermark is longer than the data."""
    e = _source(spark, lane_events(spark, sf_dir).select("fingerprint", "ts"), "dedupe")
    return _drain(spark, S.dedupe_stream(e, "1000 days"), "deduped").select("fingerprint")


def stream_terminal_state(spark, sf_dir):
    """Each lane's final state as the last batch that touched it left it."""
    e = _source(spark, lane_events(spark, sf_dir).select("lane", F.col("event_id").alias("seq"), "event"), "lanes")
    got = _drain(spark, S.terminal_state(e), "states", "update")
    return got.groupBy("lane").agg(F.max_by(F.struct("seq", "event"), "batch").alias("s")).select("lane", "s.seq", "s.event")


def stream_sink_json(spark, sf_dir):
    """Events appended to a JSON log and read again."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type")
    path = scratch(spark, "log")
    S.json_sink(_source(spark, df, "append"), path, scratch(spark, "log-state")).start().awaitTermination()
    return spark.read.schema(df.schema).json(path)


def _in_runs(spark, df, order, of, name, runs=3):
    """All rows that `of` gives a stream of df whose files arrive in `runs` slices by `order`; the query stops after each and starts again from its checkpoint."""
    path, out, state = (scratch(spark, f"{name}-{x}") for x in ("in", "out", "state"))
    low, high = df.agg(F.min(order), F.max(order)).first()
    if low is None:
        low = high = 0
    cuts = [low + (high - low + 1) * i // runs for i in range(runs + 1)]
    with SF.rocksdb_state(spark):
        for a, b in zip(cuts, cuts[1:]):
            df.where((F.col(order) >= a) & (F.col(order) < b)).write.mode("append").parquet(path)
            found = of(spark.readStream.schema(df.schema).parquet(path))
            found.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def stream_nudges(spark, sf_dir):
    """Views and clicks as nudges, clicks as retries that name an original, purchases as acknowledgements: which are new, retried or stale."""
    e, bucket = table(spark, sf_dir, "events"), F.floor(F.col("value") % 40).cast("long")
    kind = F.when(F.col("event_type").isin("view", "click"), "nudge").when(F.col("event_type") == "purchase", "ack")
    d = e.select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq"), kind.alias("kind"), F.concat(F.lit("n"), bucket).alias("nudge_id"), F.when(F.col("event_type") == "click", F.concat(F.lit("n"), F.floor(bucket / 2))).alias("original_id"))
    return _in_runs(spark, d.where("kind is not null"), "seq", SF.classify_nudges, "nudges").select("lane", "seq", "nudge_id", "class")


def stream_cached_lookups(spark, sf_dir):
    """Purchases and signups store a user's completion, other events look it up: a hit within twelve hours of its present version."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "store").otherwise("lookup")
    version = F.when(F.col("event_type") == "purchase", "v1").otherwise("v0")
    d = e.select(F.col("user_id").cast("string").alias("request"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"), version.alias("version"))
    return _in_runs(spark, d, "seq", lambda s: SF.cached_lookups(s, "12 hours"), "lookups")


QUERIES = {
    "stream_windowed_counts": (stream_windowed_counts, """
        SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events) GROUP BY ALL"""),
    "stream_dedupe": (stream_dedupe, f"SELECT DISTINCT fingerprint FROM {_L}"),
    "stream_terminal_state": (stream_terminal_state, f"""
        SELECT lane, seq, CASE WHEN doubt > first THEN 'reconciled' ELSE event END AS event FROM (
          SELECT lane, min(event_id) FILTER ({_T}) AS first, arg_max(event, event_id) FILTER ({_T}) AS event, max(event_id) FILTER ({_T}) AS seq, max(event_id) FILTER (event = 'reconciled') AS doubt FROM {_L} GROUP BY lane) WHERE first IS NOT NULL"""),
    "sink_json": (stream_sink_json, "SELECT event_id, event_type FROM events"),
    "stream_nudges": (stream_nudges, """
        WITH b AS (SELECT user_id AS lane, event_id AS seq, event_type, floor(value % 40)::BIGINT AS bucket FROM events),
        d AS (SELECT lane, seq, CASE WHEN event_type = 'purchase' THEN 'ack' ELSE 'nudge' END AS kind, 'n' || bucket AS nudge_id, CASE WHEN event_type = 'click' THEN 'n' || bucket // 2 END AS original_id FROM b WHERE event_type IN ('view', 'click', 'purchase')),
        done AS (SELECT lane, nudge_id, min(seq) AS seq FROM d WHERE kind = 'ack' GROUP BY ALL),
        own AS (SELECT lane, nudge_id, min(seq) AS seq FROM d WHERE kind = 'nudge' GROUP BY ALL),
        firsts AS (SELECT o.lane, o.nudge_id, o.seq, d.original_id FROM own o JOIN d ON d.lane = o.lane AND d.seq = o.seq AND d.kind = 'nudge'),
        named AS (SELECT lane, original_id AS nudge_id, min(seq) AS seq FROM firsts WHERE original_id IS NOT NULL GROUP BY ALL)
        SELECT d.lane, d.seq, d.nudge_id, CASE WHEN done.seq < d.seq OR (named.seq < d.seq AND (own.seq = d.seq OR named.seq < own.seq)) THEN 'stale' WHEN own.seq < d.seq THEN 'retry' ELSE 'new' END AS class
        FROM d JOIN own ON own.lane = d.lane AND own.nudge_id = d.nudge_id LEFT JOIN done ON done.lane = d.lane AND done.nudge_id = d.nudge_id LEFT JOIN named ON named.lane = d.lane AND named.nudge_id = d.nudge_id
        WHERE d.kind = 'nudge'"""),
    "stream_cached_lookups": (stream_cached_lookups, """
        WITH e AS (SELECT user_id::VARCHAR AS request, event_id AS seq, event_type IN ('purchase', 'signup') AS stores, event_type = 'purchase' AS present, epoch_ms(ts) AS at_ms FROM events),
        l AS (SELECT *, last_value(CASE WHEN stores THEN at_ms END IGNORE NULLS) OVER w AS stored, last_value(CASE WHEN stores THEN present END IGNORE NULLS) OVER w AS good FROM e WINDOW w AS (PARTITION BY request ORDER BY at_ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT request, seq, coalesce(good AND at_ms - stored < 43200000, false) AS hit FROM l WHERE NOT stores"""),
}
