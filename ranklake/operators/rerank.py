"""Re-ranking by vector similarity and embedding of distinct texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.config import URL_MODE_CANDIDATES


def semantic_rerank(cands: DataFrame, sim_col: str = "sim", order: str = "desc",
                    first_n: int | None = None, rank_col: str = "rank") -> DataFrame:
    """Re-order each request's candidates by similarity.

    ``desc`` (default) puts the most similar first, with NaN / NULL scores
    last; ``asc`` is the reference's order (least similar first, NaN last as
    in ``Double.compareTo``). Ties keep the incoming ``rank``. ``first_n``
    restricts the candidates to the first n by incoming rank (the reference
    looks only at 4 records). Candidates per request are bounded by the
    request's limit."""
    c = cands
    if first_n is not None:
        c = c.filter(F.col(rank_col) <= first_n)
    s = F.nanvl(F.col(sim_col), F.lit(None).cast("double"))
    key = s.desc_nulls_last() if order == "desc" else s.asc_nulls_last()
    w = Window.partitionBy("request_id").orderBy(key, F.col(rank_col))
    return c.withColumn(rank_col, F.row_number().over(w))


def semantic_rerank_reference(cands: DataFrame, sim_col: str = "sim") -> DataFrame:
    """The reference's URL-mode ordering: the first four candidates,
    ascending similarity."""
    return semantic_rerank(cands, sim_col, order="asc", first_n=URL_MODE_CANDIDATES)


def embed_distinct(texts: DataFrame, embedder, text_col: str = "text") -> DataFrame:
    """One embedding per distinct text, joined back to every row.

    ``embedder(distinct_df) -> DataFrame(text_col, vector)`` is either a
    lookup against a stored vector table or a ``mapInPandas`` model call;
    it sees each distinct text once (the reference memoises by text)."""
    distinct = texts.select(text_col).distinct()
    vecs = embedder(distinct)
    return texts.join(vecs, text_col, "left")
