"""Query forms, per-request failure and the directory scan's corner cases."""

import pytest
from pyspark.sql import functions as F

from ranklake.operators.postings import SearchIndex, index_registry
from ranklake.operators.query import clauses_from_q, query_error
from ranklake.operators.requests import (requests_with_defaults, valid_requests,
                                         validate_requests)
from ranklake.operators.scoring import evaluate
from ranklake.plans.search import search
from ranklake.sources.metadata import scan_metadata_dir

DOCS = [(1, "alpha beta gamma"), (2, "alpha gamma"), (3, "beta delta"), (4, "x alphabet a")]


@pytest.fixture(scope="module")
def index(spark):
    rows = [("i", d, str(d), t) for d, t in DOCS]
    return SearchIndex.build(spark.createDataFrame(rows, "index_name string, doc_id long, doc_key string, text string"))


def hits(spark, index, *queries, **kw):
    reqs = spark.createDataFrame([(n, "i", q, 20) for n, q in enumerate(queries)],
                                 "request_id long, index_name string, q string, limit int")
    out = {n: set() for n in range(len(queries))}
    for r in evaluate(clauses_from_q(reqs), index, **kw).collect():
        out[r.request_id].add(r.doc_id)
    return [out[n] for n in range(len(queries))]


def test_operators(spark, index):
    assert hits(spark, index, "alpha AND beta", "alpha && beta", "alpha NOT beta", "alpha AND NOT beta", "beta OR gamma",
                "alpha AND beta delta", "alpha !beta", "+alpha -gamma", "alpha and beta", "NOT alpha") == [
        {1}, {1}, {2}, {2}, {1, 2, 3}, {1}, {2}, set(), {1, 2, 3}, set()]


def test_fuzzy_forms(spark, index):
    assert hits(spark, index, "alpah~", "alpha~0.8", "alphabex~0.8", "alpha~0", "beta~1", "~2") == [
        {1, 2}, {1, 2}, {4}, {1, 2}, {1, 3}, set()]


def test_short_terms_do_not_divide_by_zero(spark, index):
    assert hits(spark, index, '"a b"~2 alpha', "a~2")[1] == {4}


@pytest.mark.parametrize("q,bad", [
    ("plain words", False), ("a AND b", False), ("a NOT b", False), ("NOT a", False), ("a AND NOT b", False), ('"a b" c', False),
    ("(a OR b) c", False), ("/ab.*/", False), ("/a(b|c)+d{2,3}[a-z]/", False), ("[a TO b]", False), ("a* b?c a~ a~1 a~0.8 a^2", False),
    (None, True), ("", True), (" \t ", True), ('"open', True), ("[a TO b", True), ("a]b", True), ("{x}", True), ("*a", True), ("?a", True),
    ("/[/", True), ("/a{3,2}/", True), ("/[z-a]/", True), ("/(a/", True), ("/*a/", True), ('"a b"~2', True), ("AND a", True),
    ("a OR", True), ("a AND OR b", True), ("NOT", True)])
def test_query_error(spark, q, bad):
    row = spark.createDataFrame([(q,)], "q string").select(query_error("q").alias("bad")).first()
    assert row.bad is bad


def test_bad_requests_do_not_touch_the_others(spark, index):
    rows = [(1, "alpha", "i", "5"), (2, "/[/", "i", "5"), (3, "alpha", "i", "abc"), (4, '"open', "i", None), (5, "beta", "gone", "5"),
            (6, "beta", "i", "0"), (7, "beta", None, None), (8, None, "i", "3")]
    reqs = spark.createDataFrame([(i, q, x, None, None, lim) for i, q, x, lim in rows],
                                 "request_id long, q string, index string, lang string, ranking string, limit string")
    checked = validate_requests(requests_with_defaults(reqs, "i"), index_registry(index))
    assert {r.request_id: r.status for r in checked.collect()} == {1: 200, 2: 500, 3: 500, 4: 500, 5: 404, 6: 400, 7: 200, 8: 500}
    assert {r.request_id for r in valid_requests(checked).collect()} == {1, 7}
    out = search(reqs, index, None, "i")
    assert {r.request_id for r in out.results.collect()} == {1, 7}
    assert out.rejected.count() == 6


def test_search_applies_the_syntax(spark, index):
    reqs = spark.createDataFrame([(1, "+alpha -beta", "i", None, None, 5), (2, "alph* AND gamma", "i", None, None, 5)],
                                 "request_id long, q string, index string, lang string, ranking string, limit int")
    got = {(r.request_id, r.url) for r in search(reqs, index, None, "i").results.collect()}
    assert got == {(1, "2"), (2, "1"), (2, "2")}


def test_phrases_above_the_broadcast_bound(spark, index):
    qs = ['"alpha beta"', '"beta gamma" delta', '"gamma alpha"']
    assert hits(spark, index, *qs) == hits(spark, index, *qs, max_rows=0) == [{1}, {1, 3}, set()]


def test_wide_prefix_is_not_broadcast(spark, index):
    assert hits(spark, index, "a*", max_rows=2) == hits(spark, index, "a*") == [{1, 2, 4}]


def test_scan_of_an_empty_directory_leaves_the_schema_alone(spark, tmp_path):
    for _ in range(2):
        assert scan_metadata_dir(spark, str(tmp_path)).count() == 0
    (tmp_path / "broken.parquet").write_bytes(b"no parquet")
    assert scan_metadata_dir(spark, str(tmp_path)).count() == 0
    spark.createDataFrame([("1", "u", "t", "p", "en", "d")], "record_id string, url string, title string, plain_text string, language string, "
                          "warc_date string").coalesce(1).write.parquet(str(tmp_path / "parts"))
    part = next((tmp_path / "parts").glob("part-*.parquet"))
    part.rename(tmp_path / "idx.parquet")
    assert [(r.index_name, r.file_pos) for r in scan_metadata_dir(spark, str(tmp_path)).select("index_name", "file_pos").collect()] == [("idx", 0)]


def test_lang_filter(spark):
    from ranklake.operators.enrich import lang_filter
    rows = spark.createDataFrame([("EN", "en"), ("en", None), (None, None), ("de", "en")], "lang string, language string")
    assert lang_filter(rows).count() == 2
    assert F is not None


def test_store_follows_its_input(spark, sf, tmp_path):
    import shutil

    from ranklake.plans.store import _input_state
    for name in ("documents", "pages"):
        shutil.copyfile(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    before = _input_state(spark, str(tmp_path))
    assert before == _input_state(spark, str(tmp_path))
    spark.read.parquet(f"{sf}/documents.parquet").limit(5).coalesce(1).write.parquet(str(tmp_path / "more"))
    shutil.copyfile(next((tmp_path / "more").glob("part-*.parquet")), tmp_path / "documents.parquet")
    assert before != _input_state(spark, str(tmp_path))


def test_pattern_form_holds_every_token(spark):
    """One form for each token of a passage, the last one included."""
    from ranklake.plans.catalog import pattern_form
    for n in range(1, 10):
        toks = [f"tok{k}" for k in range(n)]
        q = spark.createDataFrame([(toks,)], "toks array<string>").select(pattern_form().alias("q")).first().q
        rows = spark.createDataFrame([(1, "i", 5, q)], "request_id long, index_name string, limit int, q string")
        assert clauses_from_q(rows).count() == n
    assert q.split()[-1] == "tok*" and "[tok3 TO tok4]" in q


def test_fuzzy_neighbourhood_against_brute_force(spark):
    """Every dictionary term within the edits is found through its deletion
    signatures: random words, words shorter than the edits, long ones."""
    import random

    from ranklake.functions.text import deletion_signatures
    rng = random.Random(4)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 14))) for _ in range(250)}
    words |= {"a" * 300, "a" * 301, "b" + "a" * 300, "a" * 150 + "b" + "a" * 150, "é", "éa", "漢字", "漢字x"}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j] + 1, row[j + 1] + 1, last + (x != y))
        return row[-1]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    sig = {k: {r.w: set(r.s) for r in df.select("w", deletion_signatures("w", k).alias("s")).collect()} for k in (0, 1, 2)}
    short = sorted(w for w in words if len(w) < 20)
    for a in short:
        for b in short:
            if abs(len(a) - len(b)) <= 2 and (d := distance(a, b)) <= 2:
                assert sig[d][a] & sig[2][b], (a, b)
    assert sig[2]["a" * 301] & sig[2]["b" + "a" * 300]
    assert max(map(len, sig[2].values())) <= 37
    corpus = spark.createDataFrame([("i", k, str(k), w) for k, w in enumerate(sorted(words))], "index_name string, doc_id long, doc_key string, text string")
    index = SearchIndex.build(corpus)
    asked = short[::9] + ["a" * 300]
    reqs = spark.createDataFrame([(k, "i", 9, f"{w}~{k % 2 + 1}") for k, w in enumerate(asked)], "request_id long, index_name string, limit int, q string")
    got = {(r.request_id, r.doc_id) for r in evaluate(clauses_from_q(reqs), index, kinds={"fuzzy"}, max_expansions=1000).collect()}
    order = sorted(words)
    want = {(k, order.index(t)) for k, w in enumerate(asked) for t in words
            if abs(len(t) - len(w)) <= 2 and distance(w, t) <= k % 2 + 1 and distance(w, t) < min(len(t), len(w))}
    assert got == want
