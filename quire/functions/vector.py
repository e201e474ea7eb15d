"""Vectors: distances as built-in expressions, and a deterministic embedding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 768


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null where a vector is zero."""
    return 1 - dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def hashed_vector(text: str) -> np.ndarray:
    """768 values from SHA-256 of the text and a counter, as signed big-endian 32-bit numbers, length 1; zeros for no text."""
    if not text:
        return np.zeros(DIMENSIONS)
    start = hashlib.sha256(text.encode("utf-8", "surrogatepass"))
    parts = []
    for n in range(DIMENSIONS // 8):
        one = start.copy()
        one.update(n.to_bytes(4, "big"))
        parts.append(one.digest())
    values = np.frombuffer(b"".join(parts), dtype=">i4") / 2.0**31
    return values / np.sqrt((values**2).sum())


def hashed_embedding(text: str | Column) -> Column:
    """``hashed_vector`` of a column, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hashed_vector(t or "") for t in texts])

    return F.pandas_udf(run, "array<double>")(text)
