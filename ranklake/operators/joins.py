"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bounded_broadcast(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Broadcast ``df`` only when it has at most ``max_rows`` rows.

    The count is one cheap job over the small side (request-derived tables);
    beyond the bound the caller takes a shuffle join instead."""
    n = df.count()
    if n <= max_rows:
        return F.broadcast(df), True
    return df, False


def salt_replicate(df: DataFrame, salts: int, col: str = "salt") -> DataFrame:
    """Copy every row once per salt value (the small side of a salted join)."""
    return df.withColumn(col, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def salt_spread(df: DataFrame, salts: int, by: str, col: str = "salt") -> DataFrame:
    """Salt of the large side, spread by a high-cardinality column."""
    return df.withColumn(col, F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
