"""Benchmark of the headline operators.

Builds the index once (postings, statistics and the document-to-metadata
mapping written as Parquet under the shared checkpoint folder), then runs
each headline query twice on the stored tables and reports the second
(warm) run; cold runs and the build are reported too. Every query is
materialised with the ``noop`` sink, so the full plan runs without moving
rows to the driver.

Prints one JSON line: {"metric", "value", "unit", "queries", "sf", ...}.
Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from ranklake.operators import chain  # noqa: E402
from ranklake.operators.partitioning import spread  # noqa: E402
from ranklake.plans import catalog  # noqa: E402
from ranklake.plans.store import build_store  # noqa: E402
from ranklake.operators.query import clauses_from_q  # noqa: E402
from ranklake.operators.requests import (requests_with_defaults, valid_requests,  # noqa: E402
                                         validate_requests)
from ranklake.operators.postings import index_registry  # noqa: E402
from ranklake.operators.scoring import (bm25_search, evaluate, request_bounds,  # noqa: E402
                                        topk_hits)
from ranklake.plans.search import results_json, search  # noqa: E402
from ranklake.session import get_spark, scratch_path  # noqa: E402
from ranklake.sources import fixtures as fx  # noqa: E402
from ranklake.sources.tables import read_table  # noqa: E402
from ranklake.streaming.chat_stream import ChatConfig, chat_source, stream_search  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn):
    t = time.perf_counter()
    fn()
    return time.perf_counter() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", int(cpus))
    sf = sf_dir.rsplit("sf", 1)[-1]

    # One-off build: postings + statistics + metadata + mapping, written.
    t0 = time.perf_counter()
    store = build_store(spark, sf_dir)
    build_sec = time.perf_counter() - t0
    index, meta, mapping, records = store.index, store.meta, store.mapping, store.records

    raw = fx.requests(spark, sf_dir).persist()
    raw.count()
    reqs = requests_with_defaults(raw, fx.INDEX_UUID)
    valid = valid_requests(validate_requests(reqs, index_registry(index)))
    n_req, max_lim = request_bounds(valid)
    toks = read_table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("request_id"),
        F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), 0).alias("toks"))

    def form(q):
        r = valid.drop("q").join(toks, "request_id").withColumn("q", q).drop("toks")
        return clauses_from_q(r)

    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def q_bm25_topk():
        run(topk_hits(bm25_search(valid, index), max_lim))

    def q_search():
        out = search(raw, index, meta, fx.INDEX_UUID, mapping=mapping, records=records)
        run(out.results)

    def q_results_json():
        out = search(raw, index, meta, fx.INDEX_UUID, mapping=mapping, records=records)
        run(results_json(out.results, out.valid))

    def q_retrieve_context():
        out = search(raw, index, meta, fx.INDEX_UUID, mapping=mapping, records=records)
        ch = chain.explode_chunks(out.results, "textSnippet", ["request_id", "rank", "url"])
        run(chain.stuff_context(ch))

    def q_match_bool():
        run(topk_hits(evaluate(form(catalog.bool_form()), index, kinds={"term"}), max_lim))

    def q_match_phrase():
        run(topk_hits(evaluate(form(catalog.phrase_form()), index, kinds={"phrase"}), max_lim))

    def q_match_fuzzy():
        run(topk_hits(evaluate(form(catalog.fuzzy_form()), index, kinds={"fuzzy"}), max_lim))

    def q_chunk_text():
        run(chain.explode_chunks(docs, "text", ["doc_id"]))

    def q_memory_window():
        run(chain.memory_window(read_table(spark, sf_dir, "conversations")))

    suite = {
        "bm25_topk": q_bm25_topk,
        "search": q_search,
        "results_json": q_results_json,
        "retrieve_context": q_retrieve_context,
        "match_bool": q_match_bool,
        "match_phrase": q_match_phrase,
        "match_fuzzy": q_match_fuzzy,
        "chunk_text": q_chunk_text,
        "memory_window": q_memory_window,
    }
    cold, warm = {}, {}
    for name, fn in suite.items():
        cold[name] = round(timed(fn), 3)
        warm[name] = round(timed(fn), 3)

    # Streaming: chat messages through retrieval, rows per second.
    msgs = scratch_path(spark, "bench-chat-in")
    fx.chat_json(spark, sf_dir).write.mode("overwrite").text(msgs)
    n_msgs = spark.read.text(msgs).count()
    sink = scratch_path(spark, "bench-chat-out")
    t1 = time.perf_counter()
    sq = stream_search(chat_source(spark, msgs), index, meta, ChatConfig(index=fx.INDEX_UUID),
                       fx.captions(spark, sf_dir), fx.answers(spark, sf_dir), sink,
                       mapping=mapping, records=records)
    sq.awaitTermination()
    stream_sec = time.perf_counter() - t1
    warm["stream_search"] = round(stream_sec, 3)

    total = round(sum(warm.values()), 3)
    print(json.dumps({
        "metric": "warm_query_suite_sec", "value": total, "unit": "sec",
        "queries": warm, "cold": cold, "build_index_sec": round(build_sec, 3),
        "stream_rows_per_sec": round(n_msgs / stream_sec, 1) if stream_sec else None,
        "n_requests": n_req, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
