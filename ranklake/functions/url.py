"""URL expressions: rebuild a record's URL and the keys of the
slash-tolerant URL equality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _nonempty(col) -> Column:
    c = _c(col)
    return c.isNotNull() & (c != "")


def url_schema_a(url) -> Column:
    """Schema A: stored URL with one leading ``<`` and one trailing ``>`` cut."""
    u = _c(url)
    u1 = F.when(u.startswith("<"), u.substr(F.lit(2), F.length(u))).otherwise(u)
    return F.when(u1.endswith(">"), u1.substr(F.lit(1), F.length(u1) - 1)).otherwise(u1)


def url_schema_b(scheme, subdomain, domain, suffix, path, query, fragment) -> Column:
    """Schema B: ``scheme://[sub.]domain.suffix[path][?query][#fragment]``."""
    return F.concat(
        _c(scheme), F.lit("://"),
        F.when(_nonempty(subdomain), F.concat(_c(subdomain), F.lit("."))).otherwise(F.lit("")),
        _c(domain), F.lit("."), _c(suffix),
        F.when(_nonempty(path), _c(path)).otherwise(F.lit("")),
        F.when(_nonempty(query), F.concat(F.lit("?"), _c(query))).otherwise(F.lit("")),
        F.when(_nonempty(fragment), F.concat(F.lit("#"), _c(fragment))).otherwise(F.lit("")),
    )


def url_match_keys(url) -> Column:
    """All index URLs ``l`` equal to metadata URL ``p`` under the rule
    ``l = p or l = p + "/" or p = l + "/"``: ``p``, ``p/`` and, when ``p``
    ends with a slash, ``p`` without it. Exploding these keys turns the OR
    condition into an equi-join (no cartesian product)."""
    p = _c(url)
    return F.when(
        p.endswith("/"),
        F.array(p, F.concat(p, F.lit("/")), p.substr(F.lit(1), F.length(p) - 1)),
    ).otherwise(F.array(p, F.concat(p, F.lit("/"))))
