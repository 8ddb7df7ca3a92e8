"""Vector expressions over ARRAY<FLOAT> or ARRAY<DOUBLE> columns; all sums are in double precision."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; null if the lengths differ."""
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda t, x: t + x))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where lengths differ, a vector is empty or a norm is zero."""
    ok = (F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, dot(a, b) / (norm(a) * norm(b))).otherwise(F.lit(0.0))


def l2_normalize(a: Column, floor: float = 1e-12) -> Column:
    """The vector divided by its norm, which counts as `floor` at least."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(norm(a), F.lit(floor)))


def letter_shares(text: Column) -> Column:
    """An embedder without a model: the shares of a to z among a text's characters; an empty text has zeros."""
    n = F.greatest(F.length(text), F.lit(1))
    size = F.octet_length(text)  # a letter is a byte
    return F.array(*[(size - F.octet_length(F.replace(text, F.lit(c), F.lit("")))) / n for c in "abcdefghijklmnopqrstuvwxyz"])


def _letter_shares(texts):
    raw = texts.cast(pa.binary()).to_pylist()
    shares = np.zeros((len(raw), 26))
    for i, text in enumerate(raw):
        if text:
            n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            shares[i] = n[97:123] / (len(text) - n[128:192].sum())  # characters: bytes but for those that go on one
    ends = pa.array(np.arange(0, 26 * len(raw) + 1, 26, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(shares.ravel()), mask=pa.array([text is None for text in raw], pa.bool_()))


def letter_shares_at_once(text: Column) -> Column:
    """letter_shares from one pass over a text, in Python: for whole tables of texts. Null for a null text."""
    return F.arrow_udf(_letter_shares, "array<double>")(text)
