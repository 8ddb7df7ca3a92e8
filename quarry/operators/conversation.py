"""Conversation analytics: usage and cost, compaction boundaries, runs, pairing and clustering."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.text import byte_token_estimate

#: USD a million tokens of input, output, cache writes and cache reads; the first name found in a model's decides.
PRICES = (
    (("haiku",), (1.0, 5.0, 1.25, 0.1)), (("opus",), (5.0, 25.0, 6.25, 0.5)), (("sonnet",), (3.0, 15.0, 3.75, 0.3)),
    (("gpt-4o-mini", "gpt-4.1-mini"), (0.15, 0.60, 0.15, 0.075)), (("deepseek-v4-flash", "deepseek-chat", "deepseek-reasoner"), (0.14, 0.28, 0.14, 0.0028)),
    (("deepseek",), (0.435, 0.87, 0.435, 0.003625)), (("grok",), (1.25, 2.5, 1.25, 0.2)), (("qwen-plus", "kimi"), (0.4, 1.2, 0.4, 0.4)),
)
DEFAULT_PRICES = (3.0, 15.0, 3.75, 0.3)


def price(model: Column, kind: int) -> Column:
    """USD a million tokens of one of the four kinds; an unknown model has the default."""
    out = F.lit(DEFAULT_PRICES[kind])
    for names, prices in reversed(PRICES):
        test = F.lit(False)
        for n in names:
            test = test | F.contains(F.lower(model), F.lit(n))
        out = F.when(test, prices[kind]).otherwise(out)
    return out


def chatty_runs(messages: DataFrame, least: int = 4, max_bytes: int = 200) -> DataFrame:
    """Maximal runs of at least `least` neighbouring short messages: (conv_id, first_turn, last_turn, n)."""
    w = W.partitionBy("conv_id").orderBy("turn")
    m = messages.withColumn("short", F.octet_length("text") < max_bytes)
    m = m.withColumn("island", F.sum(F.when(F.col("short") & F.coalesce(F.lag("short").over(w), F.lit(False)), 0).otherwise(1)).over(w))
    return m.where("short").groupBy("conv_id", "island").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count("*").alias("n")).where(F.col("n") >= least).drop("island")


def compress_summary(summaries: DataFrame, max_lines: int = 24, max_chars: int = 1200, line_chars: int = 160) -> DataFrame:
    """(id, text) cut to a budget: lines collapsed and deduplicated ignoring case, the most important first, a line that doesn't fit skipped."""
    def importance(line: str) -> int:
        low = line.lower()
        return 0 if low.startswith("#") or low.endswith(":") else 1 if low.startswith(("- ", "* ")) else 2 if ":" in low else 3

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for key, text in zip(pdf.id, pdf.text):
                lines, seen = [], set()
                for raw in (text or "").split("\n"):
                    line = " ".join(raw.split())
                    line = line if len(line) <= line_chars else line[: line_chars - 1] + "…"
                    if line and line.lower() not in seen:
                        seen.add(line.lower())
                        lines.append(line)
                kept, size = set(), 0
                for _, i in sorted((importance(x), i) for i, x in enumerate(lines)):
                    cost = len(lines[i]) + bool(kept)
                    if len(kept) < max_lines and size + cost <= max_chars:
                        kept.add(i)
                        size += cost
                out.append((key, "\n".join(lines[i] for i in sorted(kept)), len(lines) - len(kept)))
            yield pd.DataFrame(out, columns=["id", "text", "omitted"])

    return summaries.select("id", "text").mapInPandas(run, "id long, text string, omitted long")


def compaction_split(messages: DataFrame, keep: int = 4) -> DataFrame:
    """Each conversation's first kept turn: `keep` from the end, moved back over a tool result to the turn before it."""
    w = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    m = messages.withColumn("r", F.row_number().over(w)).withColumn("before", F.lag("turn").over(W.partitionBy("conv_id").orderBy("turn")))
    first = m.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max(F.when(F.col("r") <= keep, F.col("r"))).alias("k"))
    return m.join(first, "conv_id").where(F.col("r") == F.col("k")).select("conv_id", "n_messages", F.when((F.col("role") == "tool") & F.col("before").isNotNull(), F.col("before")).otherwise(F.col("turn")).alias("first_kept"))


def needs_compaction(messages: DataFrame, least: int = 4, tokens: int = 10_000) -> DataFrame:
    return messages.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(byte_token_estimate(F.col("text"))).cast("long").alias("tokens")).select("conv_id", "n", "tokens", ((F.col("n") > least) & (F.col("tokens") >= tokens)).alias("needs"))
