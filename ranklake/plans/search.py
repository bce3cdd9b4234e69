"""The search endpoint as one lazy plan over a table of requests:

requests -> defaults -> validation -> clauses -> BM25 -> (metadata join ->
language filter -> top-k | top-k) -> result fields -> word-count re-rank.

Shuffles: postings join (none where the terms are broadcast, otherwise salted),
score aggregation by (request, doc) and score x document-metadata mapping (none
where both are stored in the same shards by document), top-k by request
(partial limit before the exchange). The result fields over
``plain_text`` are computed only for the surviving top-k rows.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.config import (BLOCK_MIN_REQUESTS, BLOCK_MIN_ROWS, BROADCAST_MAX_BYTES, BROADCAST_MAX_ROWS,
                             DEFAULT_LIMIT, PRUNE_RATIO, RANKING_ASC, RANKING_DESC, TASK_ROWS)
from ranklake.operators.blocks import block_topk, numbered_rows, plain_requests, said
from ranklake.operators.enrich import (BARE_POS, RECORD_COLUMNS, RESULT_COLUMNS, askable,
                                       by_document, doc_meta, result_hits, result_records)
from ranklake.operators.postings import SearchIndex, index_registry
from ranklake.operators.pruning import pruned_topk
from ranklake.operators.query import clauses_from_q
from ranklake.operators.requests import (rejected_requests, requests_with_defaults,
                                         valid_requests, validate_requests)
from ranklake.operators.scoring import evaluate, request_bounds, topk_hits
from ranklake.session import release


def _bounded(df: DataFrame, n_rows: int) -> DataFrame:
    return F.broadcast(df) if n_rows <= BROADCAST_MAX_ROWS else df


def rerank_word_count(rows: DataFrame, ranking_col: str = "ranking",
                      rank_col: str = "rank", wc_col: str = "wordCount",
                      mode_col: str | None = None) -> DataFrame:
    """``asc`` / ``desc`` (any case) re-orders a request's rows by word
    count, stable on the relevance rank; other values keep relevance order,
    and so do rows of an index without metadata (``mode = 'bare'``).
    One window per request over at most ``limit`` rows."""
    r = F.lower(F.col(ranking_col))
    key = (F.when(r == RANKING_ASC, F.col(wc_col))
           .when(r == RANKING_DESC, -F.col(wc_col)).otherwise(F.lit(0)))
    if mode_col is not None:
        key = F.when(F.col(mode_col) == "bare", F.lit(0)).otherwise(key)
    w = Window.partitionBy("request_id").orderBy(key, F.col(rank_col))
    return rows.withColumn(rank_col, F.row_number().over(w))


@dataclass
class SearchOutput:
    results: DataFrame    # request_id, rank, url, id, title, textSnippet, ...
    rejected: DataFrame   # request rows with status != 200 and error text
    valid: DataFrame      # accepted requests (request_id, q, index_name, ...)


def search(requests: DataFrame, index: SearchIndex, metadata: DataFrame | None,
           default_index: str, default_limit: int = DEFAULT_LIMIT,
           clauses_fn=None, kinds: set[str] | None = None,
           quantize: bool = False, rerank: bool = True,
           mapping: DataFrame | None = None,
           records: DataFrame | None = None, prune: bool | None = None,
           blocks: bool | None = None, record_fields: dict[str, Column] | None = None) -> SearchOutput:
    """Answer every request of ``requests(request_id, q, index, lang,
    ranking, limit)``. ``metadata`` is canonical metadata (or None);
    ``mapping`` and ``records`` may pass the stored ``doc_meta`` and
    ``result_records`` tables of the index. ``clauses_fn`` makes the clauses of
    the accepted requests; by default ``clauses_from_q`` with the index's analyser.

    Scoring runs once for all indexes: documents of indexes without
    metadata reach the top-k through ``bare`` mapping rows. ``prune`` asks for
    the top-k by bounds (``operators.pruning``, the same rows); by default it
    is taken where an index holds ``PRUNE_RATIO`` times as many documents as
    the largest limit, from where leaving documents out pays for its passes.
    Not on postings stored by document: there full scoring moves nothing but
    the best rows of each shard, while the passes store every partial score.
    ``blocks`` asks for plain requests to be answered block by block
    (``operators.blocks``, the same rows); by default it is taken from
    ``BLOCK_MIN_REQUESTS`` requests with ``BLOCK_MIN_ROWS`` result rows, from
    where the best rows of each shard are more than the documents.
    ``record_fields`` are further columns of the results, made of a record's
    fields once per record."""
    reqs = requests_with_defaults(requests, default_index, default_limit)
    # Read by every step below: checked and parsed once.
    validated = validate_requests(reqs, index_registry(index)).checkpoint(eager=True)
    valid = valid_requests(validated)
    n_req, max_lim = request_bounds(valid)
    clauses_of = clauses_fn or (lambda v: clauses_from_q(v, index.analyser))
    if mapping is None:
        mapping = doc_meta(index.doc_stats, metadata)
    if blocks is None:
        blocks = not prune and n_req >= BLOCK_MIN_REQUESTS and n_req * max_lim >= BLOCK_MIN_ROWS
    parts, asked = [], valid
    if blocks and not quantize:
        clauses = said(clauses_of(valid))
        plain = plain_requests(valid, clauses).checkpoint(eager=True)
        here = valid.join(plain, "request_id", "left_semi")
        parts.append(_block_rows(here, clauses.join(plain, "request_id", "left_semi"), index, metadata, mapping, records, n_req, max_lim, rerank, record_fields))
        asked = valid.join(plain, "request_id", "left_anti").checkpoint(eager=True)
        n_req, max_lim = request_bounds(asked)
    if not parts or n_req:
        parts.append(_scored_rows(asked, clauses_of(asked), index, metadata, mapping, records, n_req, max_lim, kinds, quantize, rerank,
                                  record_fields, prune))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    results = rows.select("request_id", "rank", *RESULT_COLUMNS, *(record_fields or {}))
    return SearchOutput(results, rejected_requests(validated), valid)


def _records(index: SearchIndex, metadata: DataFrame | None, records: DataFrame | None, needed) -> DataFrame:
    """Result records: per-record fields (stored, or computed only for the
    distinct records ``needed()``) plus one empty record per index without
    metadata (file_pos -1, matched by its ``bare`` rows), so one inner join with
    the top-k serves both kinds of index."""
    names = index_registry(index)
    if metadata is not None:
        names = names.join(F.broadcast(metadata.select("index_name").distinct()),
                           "index_name", "left_anti")
    empty = names.select("index_name", F.lit(BARE_POS).cast("long").alias("file_pos"),
                         *[F.lit(None).cast("int" if c == "wordCount" else "string").alias(c)
                           for c in RECORD_COLUMNS])
    if records is None and metadata is not None:
        records = result_records(metadata.join(needed(), ["index_name", "file_pos"], "left_semi"))
    return empty if records is None else records.select(
        "index_name", "file_pos", *RECORD_COLUMNS).unionByName(empty)


def _reranked(rows: DataFrame, valid: DataFrame, n_req: int) -> DataFrame:
    req_side = _bounded(valid.select("request_id", "ranking"), n_req)
    return rerank_word_count(rows.join(req_side, "request_id", "inner"), mode_col="mode").drop("ranking")


def _scored_rows(valid: DataFrame, clauses: DataFrame, index: SearchIndex, metadata: DataFrame | None, mapping: DataFrame,
                 records: DataFrame | None, n_req: int, max_lim: int, kinds: set[str] | None, quantize: bool, rerank: bool,
                 record_fields: dict[str, Column] | None, prune: bool | None) -> DataFrame:
    """The result rows of ``valid``, by the score of every (request, document)
    or by bounds."""
    clauses = clauses.checkpoint(eager=True)
    # One small job: how many clauses there are and of which kinds, so the plan
    # holds only those.
    found = clauses.agg(F.count(F.lit(1)).alias("n"), F.collect_set("kind").alias("kinds")).first()
    kinds = kinds or set(found.kinds) or {"term"}
    # Documents that no request can be answered with are not scored; statistics
    # are those of the whole index.
    index = replace(index, postings=by_document(index.postings, askable(mapping, valid), "left_semi"))
    keep = lambda scores: result_hits(scores, valid, mapping, n_req)
    order = [F.col("file_pos")]
    if prune is None and index.shards is not None:
        prune = False
    elif prune is None:
        docs = index.corpus_stats.agg(F.max("n_docs")).first()[0] or 0
        prune = docs >= PRUNE_RATIO * max(max_lim, 1)
    if prune and not quantize:
        ranked = pruned_topk(clauses, index, max_lim, found.n, n_req, keep, order, kinds)
    else:
        ranked = topk_hits(keep(evaluate(clauses, index, quantize=quantize, kinds=kinds, n_clauses=found.n)), max_lim, order)
    # The top-k rows (at most requests x largest limit) feed two consumers
    # (the records they need and the final join): a reliable checkpoint in
    # the shared folder computes the scoring once and cuts the lineage.
    ranked = ranked.select(
        "request_id", "index_name", "file_pos", "mode", "out_url", "rank").checkpoint(eager=True)
    top_bound = max(n_req * max(max_lim, 1), 1)
    top = _bounded(ranked, top_bound)
    recs = _records(index, metadata, records, lambda: _bounded(ranked.select("index_name", "file_pos").distinct(), top_bound))
    rows = recs.withColumns(record_fields or {}).join(top, ["index_name", "file_pos"], "inner").select(
        "request_id", "rank", "mode", F.col("out_url").alias("url"), *RECORD_COLUMNS, *(record_fields or {}))
    return _reranked(rows, valid, n_req) if rerank else rows


def _block_rows(valid: DataFrame, clauses: DataFrame, index: SearchIndex, metadata: DataFrame | None, mapping: DataFrame,
                records: DataFrame | None, n_req: int, max_lim: int, rerank: bool, record_fields: dict[str, Column] | None) -> DataFrame:
    """The result rows of plain requests, block by block (``operators.blocks``).

    What is stored is one row of numbers per request. It is dealt out by request
    once; the rows behind the numbers are listed inside those tasks, re-ranked
    by their word counts and meet their texts last, so no result row is moved."""
    numbered = numbered_rows(mapping, valid)
    top = block_topk(valid, clauses, index, numbered, max_lim).checkpoint(eager=True)
    release(valid.sparkSession)
    recs = _records(index, metadata, records, lambda: numbered.select("index_name", "file_pos").distinct())
    n_rows = numbered.count()
    # A result row's texts, once for each document that can be one.
    held = (recs.withColumns(record_fields or {}).join(_bounded(numbered.drop("language"), n_rows), ["index_name", "file_pos"])
            .select("row", "mode", F.col("out_url").alias("url"), *RECORD_COLUMNS, *(record_fields or {}))
            .withColumn("held", F.monotonically_increasing_id()).checkpoint(eager=True))
    size = held.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.coalesce(F.length(F.col(c).cast("string")), F.lit(0))
                    for c in held.columns), F.lit(0))).alias("chars")).first()
    texts = held.drop("row", "mode")
    texts = _bounded(texts, size.n) if (size.chars or 0) <= BROADCAST_MAX_BYTES else texts
    tasks = max(1, -(-n_req * max(max_lim, 1) // TASK_ROWS))
    rows = (top.repartition(tasks, "request_id").select("request_id", F.posexplode("rows").alias("place", "row"))
            .join(_bounded(held.select("row", "held", "mode", F.col("wordCount").alias("words")), size.n), "row")
            .select("request_id", (F.col("place") + 1).alias("rank"), "held", "mode", F.col("words").alias("wordCount")))
    if rerank:
        rows = _reranked(rows, valid, n_req)
    return rows.drop("wordCount").join(texts, "held").drop("held")


def results_json(results: DataFrame, valid: DataFrame) -> DataFrame:
    """``{"results": [...]}`` per accepted request (empty array when nothing
    matched); rows per request are bounded by its limit."""
    item = F.struct("rank", *RESULT_COLUMNS)
    per_req = results.groupBy("request_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    arr = F.transform(F.coalesce(F.col("items"), F.array().cast(per_req.schema["items"].dataType)),
                      lambda x: F.struct(*[x.getField(c).alias(c) for c in RESULT_COLUMNS]))
    return (valid.select("request_id").join(per_req, "request_id", "left")
            .select("request_id", F.to_json(F.struct(arr.alias("results"))).alias("json")))
