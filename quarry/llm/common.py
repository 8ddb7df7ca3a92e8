"""Helpers that the operators of this subpackage share.

A *word* is a maximal run of characters other than the ASCII white space
U+0020 and U+0009 to U+000D, everywhere in this subpackage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words, for Java's, RE2's and Python's regular expressions alike.
SPACES = r"[\x20\x09-\x0D]+"
#: Bytes of text that a Python worker works on at once.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one is made where it is unset and all run in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
        named = spark.sparkContext.getCheckpointDir()
    return named.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/quarry-{spark.sparkContext.applicationId}"


def clear_intermediates(spark: SparkSession) -> None:
    """Delete this application's intermediate tables; results that read them lazily must have been written before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: what follows never recomputes it."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text in order; none of a null."""
    plain = F.coalesce(text, F.lit(""))
    for space in "\t\n\x0b\f\r":
        plain = F.replace(plain, F.lit(space), F.lit(" "))
    return F.array_remove(F.split(plain, " "), "")  # splitting at one plain character is several times faster than at a pattern


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions_for(spark: SparkSession, size_bytes: int, each_bytes: int) -> int:
    """As many partitions as parts of each_bytes, and no fewer than spark.sql.shuffle.partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size_bytes) // each_bytes))


def slices(batch: pa.RecordBatch, column: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `limit` bytes of a text column; a longer text is a part of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with its columns renamed c0, c1, ... (so no name clashes) and a number per row, `row`; and the old names."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumn("row", F.monotonically_increasing_id()), docs.columns


def without(rows: DataFrame, gone: DataFrame, names: list[str]) -> DataFrame:
    """The rows of a numbered table whose number is not in gone (row), under their old names."""
    return rows.join(gone.select("row"), "row", "left_anti").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
