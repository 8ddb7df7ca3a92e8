"""All queries of the library outside the corpus operators, each with its SQL.

A module of this package lists its queries as QUERIES: name -> (function, SQL or None).
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODULES = ("retrieval", "text", "conversation", "events", "search", "learning", "ingest", "streams", "records")


def _entries() -> dict:
    found: dict = {}
    for name in MODULES:
        for k, v in importlib.import_module(f"quarry.plans.{name}").QUERIES.items():
            if k in found:
                raise ValueError(f"two queries are named {k}")
            found[k] = v
    return found


def _wide(f: Callable) -> Callable:
    """f with its 32-bit numbers as 64-bit ones, as SQL has them."""
    def run(spark, sf_dir: str) -> DataFrame:
        df = f(spark, sf_dir)
        return df.withColumns({c: F.col(f"`{c}`").cast("long") for c, kind in df.dtypes if kind in ("int", "smallint", "tinyint")})

    run.__name__, run.__doc__ = f.__name__, f.__doc__
    return run


def queries() -> dict:
    return {k: _wide(f) for k, (f, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries().items() if sql}
