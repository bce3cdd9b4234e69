"""Vectors in blocks: what the embedding operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, vec: str = "embedding") -> DataFrame:
    """``table`` with ``ok``: the vector is not null, not empty, not all zero
    and holds no null or non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    zero = F.forall(vec, lambda x: x == 0)
    return table.withColumn("ok", F.coalesce(F.col(vec).isNotNull() & ~bad & ~zero, F.lit(False)))


def matrix(column) -> np.ndarray:
    """Rows of equal length as a double matrix."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings the largest component near 1:
    exact, and squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / lengths(x)[:, None]
