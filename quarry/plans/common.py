"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.expansions import DOMAIN_TERMS, SYNONYMS
from quarry.operators.common import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A new path in the folder that the cluster shares.
scratch = shared_path


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)


_DOMAINS = _values((name, i * 100 + j, t) for i, (name, ts) in enumerate(sorted(DOMAIN_TERMS.items())) for j, t in enumerate(ts))
_PAIRED = _values([(a, i, b) for i, (a, b) in enumerate(SYNONYMS)] + [(b, i, a) for i, (a, b) in enumerate(SYNONYMS)])


def expand_sql(source: str) -> str:
    """The expanded keywords (query, pos, keyword) of keywords (query, pos, keyword)."""
    return f"""(
  SELECT query, rank AS pos, keyword FROM (
    SELECT *, min(CASE WHEN rank = 20 THEN pos END) OVER (PARTITION BY query) AS last_pos,
           coalesce(max(CASE WHEN rank >= 20 AND kind = 1 THEN 1 END) OVER (PARTITION BY query ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS late FROM (
      SELECT *, row_number() OVER (PARTITION BY query ORDER BY pos, kind, ordinal) AS rank FROM (
        SELECT * FROM (
          SELECT query, pos, 0 AS kind, 0 AS ordinal, keyword FROM {source}
          UNION ALL SELECT query, pos, 1, ordinal, term FROM {source} JOIN (VALUES {_DOMAINS}) d(name, ordinal, term) ON contains(lower(keyword), name)
          UNION ALL SELECT query, pos, 2, ordinal, term FROM {source} JOIN (VALUES {_PAIRED}) p(name, ordinal, term) ON lower(keyword) = name)
        QUALIFY row_number() OVER (PARTITION BY query, lower(keyword) ORDER BY pos, kind, ordinal) = 1)))
  WHERE rank <= 20 OR (pos = last_pos AND late = 0))"""
