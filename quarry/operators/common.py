"""What operators share: intermediate tables in the folder that a cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a temporary one only where all run in one process and none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="quarry-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back: what follows never computes it again, and plans stay short."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a task, about, where an operator must hold or sort a partition.
TASK_ROWS = 1 << 20


def spread(rows: int, spark: SparkSession, each: int = TASK_ROWS) -> int:
    """Partitions for a number of rows: the session's, or as many more as keep each at about `each` rows.

    Above bypassMergeThreshold partitions a shuffle's writers keep all rows of their split in memory to sort them:
    partitions take up to twice as many rows where that keeps to this number.
    """
    direct = int(spark.conf.get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    n = -(-rows // each)
    if n > direct:
        n = max(direct, -(-n // 2))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), n)
