"""Physical plan properties that matter at scale."""

import contextlib
import io

from pyspark.sql import functions as F

from ranklake.operators.enrich import metadata_by_id, url_join
from ranklake.operators.scoring import bm25_search, topk_hits
from ranklake.plans.search import search
from ranklake.plans.store import store_for
from ranklake.sources import fixtures as fx


def plan(df, mode="formatted"):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


def test_topk_is_partial_before_shuffle(spark, sf):
    st = store_for(spark, sf)
    reqs = spark.createDataFrame([(1, "demo_a", "the of and", 20)],
                                 "request_id long, index_name string, q string, limit int")
    p = plan(topk_hits(bm25_search(reqs, st.index), 20))
    assert p.count("WindowGroupLimit") >= 2          # partial + final
    assert "BroadcastHashJoin" in p                   # checked-size query side broadcast


def test_scoring_reads_no_positions(spark, sf):
    st = store_for(spark, sf)
    reqs = spark.createDataFrame([(1, "demo_a", "the of", 20)],
                                 "request_id long, index_name string, q string, limit int")
    p = plan(bm25_search(reqs, st.index))
    schemas = [ln for ln in p.splitlines() if "ReadSchema" in ln and "tf" in ln]
    assert schemas and all("positions" not in ln for ln in schemas)


def test_url_join_is_equi_join(spark, sf):
    st = store_for(spark, sf)
    docs = st.index.doc_stats.filter(F.col("index_name") == "demo_b")
    p = plan(url_join(docs, st.meta.select("index_name", F.col("url").alias("u"), "file_pos"),
                      url_col="u"))
    assert "CartesianProduct" not in p and "NestedLoopJoin" not in p


def test_dedup_is_aggregation_not_window(spark, sf):
    p = plan(metadata_by_id(store_for(spark, sf).meta.select("index_name", "id", "file_pos")))
    assert "Aggregate" in p and "Window" not in p


def test_search_scans_postings_once(spark, sf):
    st = store_for(spark, sf)
    out = search(fx.requests(spark, sf), st.index, st.meta, "demo_a", mapping=st.mapping,
                 records=st.records)
    p = plan(out.results, "extended")
    # the top-k rows are checkpointed: the final plan reads them, and the
    # scoring (one postings scan) ran once at checkpoint time
    assert "postings" not in p.split("== Physical Plan ==")[1]


def test_fill_to_limit_scores_once(spark, sf):
    from ranklake.operators.enrich import filtered_topk
    from ranklake.operators.requests import (requests_with_defaults, valid_requests,
                                             validate_requests)
    from ranklake.operators.postings import index_registry
    st = store_for(spark, sf)
    valid = valid_requests(validate_requests(
        requests_with_defaults(fx.requests(spark, sf), "demo_a"), index_registry(st.index)))
    p = plan(filtered_topk(bm25_search(valid, st.index), valid, st.mapping, 20, 40))
    scans = [ln for ln in p.splitlines() if "Location" in ln and "/postings" in ln]
    assert len(scans) == 1


def test_score_sum_needs_no_exchange(spark, sf):
    """Stored postings are bucketed by document: nothing is shuffled between
    the postings join and the score sum."""
    st = store_for(spark, sf)
    reqs = spark.createDataFrame([(1, "demo_a", "the of and", 20)],
                                 "request_id long, index_name string, q string, limit int")
    text = plan(bm25_search(reqs, st.index, n_clauses=3), "simple")
    lines = text.splitlines()
    scan = next(i for i, ln in enumerate(lines) if "FileScan" in ln and "postings" in ln)
    depth = lambda ln: len(ln) - len(ln.lstrip(" :+-*()0123456789"))
    above, at = [], depth(lines[scan])
    for ln in reversed(lines[:scan]):
        if depth(ln) < at and ln.strip():
            at = depth(ln)
            above.append(ln)
            if "HashAggregate(keys=[request_id" in ln and "sum(" in ln and "partial" not in ln:
                break
    assert "Bucketed: true" in text
    assert above and not any("Exchange" in ln and "Broadcast" not in ln for ln in above)


def test_frequent_term_lies_in_all_shards(spark, sf):
    st = store_for(spark, sf)
    top = st.index.term_stats.where("index_name = 'demo_a'").orderBy(F.col("df").desc()).first().term
    files = st.index.postings.where((F.col("index_name") == "demo_a") & (F.col("term") == top)).select(
        F.input_file_name()).distinct().count()
    assert files >= 4


def test_index_loads_in_another_session(spark, sf):
    from ranklake.operators.postings import SearchIndex, _table_name
    st = store_for(spark, sf)
    n = st.index.postings.count()
    spark.sql(f"DROP TABLE {_table_name(st.root)}")
    again = SearchIndex.load(spark, st.root)
    assert again.postings.count() == n
    reqs = spark.createDataFrame([(1, "demo_a", "the of and", 20)],
                                 "request_id long, index_name string, q string, limit int")
    assert bm25_search(reqs, again).count() == bm25_search(reqs, st.index).count() > 0
