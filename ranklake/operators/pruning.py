"""Exact top-k that leaves out documents that cannot reach it.

A request's terms are ordered by the most a document can gain from each
(weight x the term's largest impact). The cheapest of them, with together at
most ``SPLIT`` of all that the request can gain, are its *rest*; they are the
frequent terms with the long posting lists.

1. The other terms are scored. The k-th best of these partial scores (of
   documents that pass the request's filter) bounds the k-th full score from
   below.
2. If the whole rest gains less than that bound, a document without any of the
   scored terms cannot be among the k best, nor one whose partial score and the
   whole rest stay below the bound. The documents left over are few: the rest
   is looked up for them alone.
3. Requests for which the bound does not hold (fewer than k documents found, or
   a rest that weighs too much) are scored in full, as are those with other
   clauses than optional terms.

Scores are compared with a margin beyond their rounding, so ties at the k-th
place are ranked as by full scoring.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.config import BROADCAST_MAX_ROWS, TERM_SALTS
from ranklake.functions.bm25 import idf, tf_norm
from ranklake.operators.joins import salt_replicate, salt_spread
from ranklake.operators.postings import SearchIndex
from ranklake.operators.query import SHOULD
from ranklake.operators.scoring import SCORE_DIGITS, evaluate, topk_hits

#: Part of what a request can gain that its rest may hold.
SPLIT = 0.1
#: Scores closer than this are not told apart by bounds (they are rounded to
#: ``SCORE_DIGITS`` digits, and summed in any order).
MARGIN = 10.0 ** (1 - SCORE_DIGITS)

Keep = Callable[[DataFrame], DataFrame]


def term_bounds(clauses: DataFrame, index: SearchIndex, split: float = SPLIT) -> DataFrame:
    """(request_id, index_name, limit, term, weight, avgdl, scored, rest) of
    clauses that are optional terms: ``scored`` terms find the candidates,
    ``rest`` is the most that the request's other terms can add."""
    q = (clauses.groupBy("request_id", "index_name", "limit", F.col("text").alias("term"))
         .agg(F.sum("boost").alias("wsum")))
    stats = index.term_stats.select("index_name", "term", "df", "max_impact")
    cs = F.broadcast(index.corpus_stats.select("index_name", "n_docs", "avgdl"))
    w = (stats.join(q, ["index_name", "term"]).join(cs, "index_name")
         .withColumn("weight", F.col("wsum") * idf("df", "n_docs"))
         .withColumn("gain", F.col("weight") * F.col("max_impact")))
    # a request's window holds its terms
    cheap = Window.partitionBy("request_id").orderBy("gain", "term").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("request_id")
    w = (w.withColumn("scored", F.sum("gain").over(cheap) > split * F.sum("gain").over(whole))
         .withColumn("rest", F.coalesce(F.sum(F.when(~F.col("scored"), F.col("gain"))).over(whole), F.lit(0.0))))
    return w.select("request_id", "index_name", "limit", "term", "weight", "avgdl", "scored", "rest")


def _gains(side: DataFrame, postings: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Postings that meet ``side`` (a weight each) with their gain; a small side
    is broadcast, a large one salted."""
    if small:
        h = postings.join(F.broadcast(side), keys)
    else:
        h = salt_spread(postings, TERM_SALTS, "doc_id").join(salt_replicate(side, TERM_SALTS), [*keys, "salt"])
    return h.withColumn("gain", F.col("weight") * tf_norm("tf", F.col("dl"), "avgdl"))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", SCORE_DIGITS))


def pruned_topk(clauses: DataFrame, index: SearchIndex, max_limit: int, n_clauses: int, n_requests: int,
                keep: Keep = lambda scores: scores, extra_order: list | None = None, kinds: set[str] | None = None,
                max_rows: int = BROADCAST_MAX_ROWS, split: float = SPLIT) -> DataFrame:
    """The rows that ``topk_hits(keep(evaluate(clauses)))`` gives, by way of
    bounds. ``keep`` takes scores (request_id, index_name, limit, doc_id, score)
    and may join and filter them row by row, without reading the score; the
    top-k is taken of what it returns. ``max_limit``, ``n_clauses`` and
    ``n_requests`` are bounds that the caller knows."""
    small, few = n_clauses <= max_rows, n_requests <= max_rows
    side = (lambda x: F.broadcast(x)) if few else (lambda x: x)
    full = evaluate(clauses, index, kinds=kinds, n_clauses=n_clauses, max_rows=max_rows)
    if kinds is not None and "term" not in kinds:
        return topk_hits(keep(full), max_limit, extra_order)
    plain = clauses.groupBy("request_id").agg(
        F.bool_and((F.col("kind") == "term") & (F.col("occur") == SHOULD)).alias("plain")).where("plain").select("request_id")
    # Read by every later step; as large as the clause table.
    bounds = term_bounds(clauses.join(side(plain), "request_id", "left_semi"), index, split).checkpoint(eager=True)
    postings = index.postings.select("index_name", "term", "doc_id", "tf", "dl")
    scored = bounds.where("scored").drop("scored")
    partial = (_gains(scored, postings, ["index_name", "term"], small).groupBy("request_id", "doc_id")
               .agg(F.sum("gain").alias("score")))
    about = side(bounds.select("request_id", "index_name", "limit", "rest").distinct())
    # Read twice, for the bound and for the candidates. Ranks are those of the
    # exact partial scores.
    partial = partial.join(about, "request_id").checkpoint(eager=True)
    kth = topk_hits(keep(partial.select("request_id", "index_name", "limit", "doc_id", "score", "rest")), max_limit, extra_order)
    kth = (kth.where(F.col("rank") == F.col("limit")).groupBy("request_id", "rest").agg(F.min("score").alias("bound"))
           .where(F.col("rest") + MARGIN < F.col("bound")).select("request_id", "bound").checkpoint(eager=True))
    left = (partial.join(side(kth), "request_id").where(F.col("score") + F.col("rest") + MARGIN >= F.col("bound"))
            .select("request_id", "index_name", "limit", "doc_id", "score").checkpoint(eager=True))
    # The rest of the request's terms, looked up in the candidates alone.
    asked = left.join(side(bounds.where("NOT scored").select("request_id", "term", "weight", "avgdl")), "request_id")
    asked = asked.select("request_id", "index_name", "term", "doc_id", "weight", "avgdl")
    n_left = left.count()
    per_request = -(-n_clauses // max(1, n_requests))
    found = postings.join(F.broadcast(asked) if n_left * per_request <= max_rows else asked, ["index_name", "term", "doc_id"])
    more = (found.groupBy("request_id", "doc_id")
            .agg(F.sum(F.col("weight") * tf_norm("tf", F.col("dl"), "avgdl")).alias("more")))
    exact = (left.join(more, ["request_id", "doc_id"], "left")
             .withColumn("score", F.col("score") + F.coalesce("more", F.lit(0.0))).drop("more"))
    other = clauses.join(side(kth), "request_id", "left_anti")
    rest = evaluate(other, index, kinds=kinds, n_clauses=n_clauses, max_rows=max_rows)
    cols = ["request_id", "index_name", "limit", "doc_id", "score"]
    both = _rounded(exact).select(*cols).unionByName(rest.select(*cols))
    return topk_hits(keep(both), max_limit, extra_order)
