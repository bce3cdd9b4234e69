"""Vector expressions on ``array<float>`` columns (higher-order functions,
no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot_product(a, b) -> Column:
    """Element-wise products summed in single precision, in index order, as
    the reference accumulates a ``float``; the result is float."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("float") * y.cast("float"))
    return F.aggregate(prods, F.lit(0.0).cast("float"), lambda s, x: (s + x).cast("float"))


def squared_norm(a) -> Column:
    """Sum of squares in double precision."""
    return F.aggregate(_c(a), F.lit(0.0).cast("double"),
                       lambda s, x: s + x.cast("double") * x.cast("double"))


def cosine_similarity(a, b) -> Column:
    """float dot / (sqrt(|a|^2) * sqrt(|b|^2)) in double; a zero norm gives
    NaN (0/0 in Java). ANSI division by zero is avoided by the CASE."""
    dot = dot_product(a, b).cast("double")
    den = F.sqrt(squared_norm(a)) * F.sqrt(squared_norm(b))
    return F.when(den == 0, F.lit(float("nan"))).otherwise(dot / den)
