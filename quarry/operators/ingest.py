"""Incremental ingest: what changed since the ledger, what went, and the ledger that follows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def changed_files(scan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files of the scan that the ledger lacks or has with another hash, size or time."""
    cols = ["content_hash", "size_bytes", "mtime_ms"]
    known = ledger.select("path", *[F.col(c).alias(f"_{c}") for c in cols])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return scan.join(known, "path", "left").where(~same).select(scan.columns)


def stale_files(scan: DataFrame, ledger: DataFrame) -> DataFrame:
    """Paths of the ledger that the scan no longer has."""
    return ledger.join(scan.select("path"), "path", "left_anti").select("path")


def upsert_latest(old: DataFrame, new: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both, the latest by `order` of each key."""
    r = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return old.unionByName(new).withColumn("_r", r).where("_r = 1").drop("_r")


def cascade_delete(rows: DataFrame, gone: DataFrame, key: str = "path") -> DataFrame:
    return rows.join(gone.select(key), key, "left_anti")
