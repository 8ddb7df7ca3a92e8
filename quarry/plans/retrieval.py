"""Vector and keyword search over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.vectors import cosine
from quarry.plans.common import table


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight vectors nearest to vec_id 0 by cosine: a scan, a one-row broadcast and TakeOrderedAndProject."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where(F.col("vec_id") == 0).select(F.col("embedding").alias("q"))
    return e.crossJoin(F.broadcast(q)).select("vec_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("score")).orderBy(F.desc("score"), "vec_id").limit(8)


QUERIES = {
    "vector_topk": (vector_topk, """
        SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 8"""),
}
