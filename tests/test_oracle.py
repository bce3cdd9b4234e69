"""Registered queries against their DuckDB twins on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
from ranklake.sources.tables import TABLES

FAST = ["metadata_by_id", "build_postings", "corpus_stats", "validate_requests", "bm25_score",
        "topk_hits", "filtered_topk", "search_urls_only", "url_join", "enrich_hits",
        "text_snippet", "word_count", "warc_date", "rerank_word_count", "results_json",
        "retrieve", "stuff_context", "answer_sources", "memory_window", "cosine_similarity",
        "semantic_rerank", "image_payload", "caption_query", "match_bool", "match_phrase",
        "match_pattern", "match_fuzzy", "boosted_terms", "bm25_quantized", "hit_pages",
        "search_after"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def test_every_query_registered_with_oracle_or_rows_only():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 50


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf, con, name):
    df = E.queries()[name](spark, sf)
    cols = df.columns
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    got = Counter(tuple(norm(r[i]) for i in order) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    dorder = sorted(range(len(dcols)), key=lambda i: dcols[i])
    exp = Counter(tuple(norm(r[i]) for i in dorder) for r in res.fetchall())
    assert sorted(cols) == sorted(dcols)
    assert got == exp
