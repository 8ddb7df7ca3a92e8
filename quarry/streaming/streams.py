"""Structured Streaming: deduplication within a watermark, sequence reconciliation, heartbeats, parsing and learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quarry.operators.learning import ALPHA, BETA, ETA, coaccess_pairs

TERMINAL = ("finished", "failed", "merged", "superseded", "closed")


def dedupe_stream(events: DataFrame, within: str = "1 hour", key: str = "fingerprint", ts: str = "ts") -> DataFrame:
    """Each fingerprint once within a watermark; state is dropped as the watermark passes."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour", ts: str = "ts") -> DataFrame:
    """Events a type in tumbling windows (an extension: event time has no place in the original operators)."""
    e = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return e.groupBy(F.window(ts, window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def terminal_state(events: DataFrame) -> DataFrame:
    """The state of each lane after each batch, whatever order events come in: (lane, seq, event).

    State is the first terminal number, the last terminal event and the last reconciliation;
    a reconciliation after the first terminal event relabels the lane. Events have lane, seq and event.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, event, doubt = state.get if state.exists else (1 << 62, -1, "", -1)
        for pdf in batches:
            for seq, name in zip(pdf.seq, pdf.event):
                if name in TERMINAL:
                    first = min(first, seq)
                    if seq > last:
                        last, event = seq, name
                elif name == "reconciled":
                    doubt = max(doubt, seq)
        state.update((int(first), int(last), event, int(doubt)))
        if last >= 0:
            yield pd.DataFrame({"lane": [key[0]], "seq": [last], "event": ["reconciled" if doubt > first else event]})

    return events.select("lane", "seq", "event").groupBy("lane").applyInPandasWithState(step, "lane long, seq long, event string", "first long, last long, event string, doubt long", "update", GroupStateTimeout.NoTimeout)


def heartbeats(events: DataFrame, stalled_after: str = "10 minutes", ts: str = "ts") -> DataFrame:
    """Lanes that stay silent in event time: (lane, state), "active" with each batch and "stalled" once the timeout passes. ts is a timestamp."""
    seconds = pd.Timedelta(stalled_after).total_seconds()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"lane": [key[0]], "state": ["stalled"]})
            return
        seen = max([b["seen"].max() for b in batches] + ([state.get[0]] if state.exists else []))
        state.update((int(seen),))
        state.setTimeoutTimestamp(int((seen + seconds) * 1000))
        yield pd.DataFrame({"lane": [key[0]], "state": ["active"]})

    e = events.withWatermark(ts, "0 seconds").select("lane", ts, F.unix_timestamp(ts).alias("seen"))
    return e.groupBy("lane").applyInPandasWithState(step, "lane long, state string", "seen long", "update", GroupStateTimeout.EventTimeTimeout)


def parse_stream(chunks: DataFrame) -> DataFrame:
    """Event-stream text that arrives in pieces (id, piece) as events (id, event, data): what follows the last blank line waits in state."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        text = (state.get[0] if state.exists else "") + "".join(p for b in batches for p in b.piece)
        *done, rest = text.replace("\r\n", "\n").split("\n\n")
        state.update((rest,))
        out = []
        for frame in done:
            fields = [x.partition(":")[::2] for x in frame.split("\n") if not x.startswith(":")]
            data = [v.removeprefix(" ") for k, v in fields if k == "data"]
            if data:
                out.append((key[0], next((v.removeprefix(" ") for k, v in reversed(fields) if k == "event"), "message"), "\n".join(data)))
        yield pd.DataFrame(out, columns=["id", "event", "data"])

    return chunks.select("id", "piece").groupBy("id").applyInPandasWithState(step, "id long, event string, data string", "rest string", "append", GroupStateTimeout.NoTimeout)


def fresh_completions(cached: DataFrame, now: str = "now", ttl_s: int = 30) -> DataFrame:
    """Cached rows (ts) that are younger than ttl_s at their row's `now`; at ttl_s exactly they are expired."""
    return cached.where(F.unix_timestamp(now) - F.unix_timestamp("ts") < ttl_s)


def json_sink(df: DataFrame, path: str, checkpoint: str):
    """Append-only JSON log."""
    return df.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def learn_batches(path: str, eta: float = ETA) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: posterior steps of a batch's sessions (session, item, ok) written under its number, so a batch that is run twice counts once."""
    def run(batch: DataFrame, number: int) -> None:
        p = coaccess_pairs(batch).withColumn("step", eta * F.log(1 + F.col("n") / 2))
        p.groupBy("a", "b").agg(F.sum(F.when(F.col("ok"), F.col("step")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("ok"), 0.0).otherwise(F.col("step"))).alias("down")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def learned(steps: DataFrame) -> DataFrame:
    """Posteriors from all batches' steps."""
    return steps.groupBy("a", "b").agg((F.lit(ALPHA) + F.sum("up")).alias("alpha"), (F.lit(BETA) + F.sum("down")).alias("beta"))
