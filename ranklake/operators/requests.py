"""Request tables: defaults and validation (one row per search request)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.config import (DEFAULT_LIMIT, ERR_BAD_LIMIT, ERR_NO_INDEX, ERR_NO_LIMIT,
                             ERR_NO_QUERY, RETRIEVER_INDEX, RETRIEVER_LANG, RETRIEVER_LIMIT)
from ranklake.operators.query import query_error


def requests_with_defaults(requests: DataFrame, default_index: str,
                           default_limit: int = DEFAULT_LIMIT) -> DataFrame:
    """requests(request_id, q, index, lang, ranking, limit) with the index
    and limit defaults applied; ``lang`` and ``ranking`` stay nullable.
    Output column ``index_name`` replaces ``index``. A limit that is given but
    is no integer becomes null, which ``validate_requests`` answers with 500."""
    cols = [c for c in requests.columns if c not in ("index", "limit")]
    return requests.select(
        *cols,
        F.coalesce(F.col("index"), F.lit(default_index)).alias("index_name"),
        F.when(F.col("limit").isNull(), F.lit(default_limit))
        .otherwise(F.col("limit").try_cast("int")).alias("limit"))


def retriever_requests(requests: DataFrame, index: str = RETRIEVER_INDEX,
                       lang: str | None = RETRIEVER_LANG,
                       limit: int = RETRIEVER_LIMIT) -> DataFrame:
    """Requests as the retriever sends them: where one names no index, language
    or limit, the retriever's own are filled in (100 results, ``en``), before
    the server's defaults see it. Column names are those of
    ``requests_with_defaults``' input."""
    return requests.withColumns({
        "index": F.coalesce(F.col("index"), F.lit(index)),
        "lang": F.coalesce(F.col("lang"), F.lit(lang).cast("string")),
        "limit": F.coalesce(F.col("limit"), F.lit(limit).cast(requests.schema["limit"].dataType))})


def validate_requests(requests: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``status`` and ``error`` in the order the server checks them:
    unreadable query -> 500, limit that is no integer -> 500, unknown index ->
    404, limit <= 0 -> 400, else 200.

    ``registry(index_name)`` has one row per index, so it is small by
    construction and broadcast."""
    known = F.broadcast(registry.select("index_name").distinct()
                        .withColumn("_known", F.lit(True)))
    r = requests.join(known, "index_name", "left")
    no_q = query_error("q")
    no_limit = F.col("limit").isNull()
    status = (F.when(no_q | no_limit, F.lit(500))
              .when(F.col("_known").isNull(), F.lit(404))
              .when(F.col("limit") <= 0, F.lit(400))
              .otherwise(F.lit(200)))
    error = (F.when(no_q, F.lit(ERR_NO_QUERY)).when(no_limit, F.lit(ERR_NO_LIMIT))
             .when(F.col("_known").isNull(), F.lit(ERR_NO_INDEX))
             .when(F.col("limit") <= 0, F.lit(ERR_BAD_LIMIT)))
    return r.withColumn("status", status.cast("int")).withColumn("error", error).drop("_known")


def valid_requests(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") == 200).drop("status", "error")


def rejected_requests(validated: DataFrame) -> DataFrame:
    return validated.filter(F.col("status") != 200)
