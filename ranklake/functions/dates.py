"""``warc_date`` output: a string of epoch microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ranklake.config import WARC_DATE_FORMAT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def warc_date_schema_a(col) -> Column:
    """Parse ``yyyy-MM-dd'T'HH:mm:ss'Z'`` (UTC) to micros as text; an
    unparsable value is kept as it is. ``try_to_timestamp`` because ANSI mode
    makes the plain parse raise."""
    s = _c(col)
    micros = F.unix_micros(F.try_to_timestamp(s, F.lit(WARC_DATE_FORMAT)))
    return F.coalesce(micros.cast("string"), s)


def warc_date_schema_b(col) -> Column:
    """Schema B stores micros as a long: the output is its text."""
    return _c(col).cast("string")
