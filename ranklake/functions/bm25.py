"""BM25 pieces as column expressions (Lucene >= 8 form, without the
``(k1 + 1)`` factor)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklake.config import B, K1


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def idf(df, n_docs) -> Column:
    """``ln(1 + (N - df + 0.5) / (df + 0.5))``."""
    d = _c(df).cast("double")
    return F.log(1.0 + (_c(n_docs).cast("double") - d + 0.5) / (d + 0.5))


def tf_norm(tf, dl, avgdl, k1: float = K1, b: float = B) -> Column:
    """``tf / (tf + k1 * (1 - b + b * dl / avgdl))``."""
    t = _c(tf).cast("double")
    return t / (t + k1 * ((1.0 - b) + b * _c(dl).cast("double") / _c(avgdl)))


def quantized_length(dl) -> Column:
    """Document length after Lucene's one-byte norm encoding
    (``SmallFloat.intToByte4`` then back): exact below 24, else the top four
    significant bits of ``dl - 24`` kept."""
    x = _c(dl).cast("long")
    rest = x - 24
    shift = F.greatest(F.length(F.bin(rest)) - 4, F.lit(0))
    low_bits = F.pmod(rest, F.pow(F.lit(2), shift).cast("long"))
    return F.when(x < 24, x).otherwise(F.lit(24) + rest - low_bits).cast("long")
