"""What is stored and scored by document shards, on rows of its own."""

import os
import re

from pyspark.sql import functions as F

from ranklake.operators.enrich import askable, result_hits
from ranklake.operators.postings import SearchIndex, build_postings, save_by_document, shards_for
from ranklake.operators.query import clauses_from_q
from ranklake.operators.scoring import evaluate
from test_plans import plan

REQUEST = "request_id long, index_name string, q string, limit int"
MAPPING = "index_name string, doc_id long, file_pos long, language string, mode string, out_url string"


def corpus(spark, n=40):
    rows = [(name, i, f"{name}-{i}", f"alpha{i} beta gamma{i % 7} tan{i % 3}") for i in range(n) for name in ("a", "b")]
    return spark.createDataFrame(rows, "index_name string, doc_id long, doc_key string, text string")


def test_store_shuffles_texts_not_postings(spark):
    """Both indexes' texts of a document are analysed once, behind the only exchange."""
    c = corpus(spark)
    laid = build_postings(c, shards=5)
    text = plan(laid, "simple")
    assert text.count("Exchange") == 1 and "hashpartitioning(doc_id" in text
    assert text.index("Generate") < text.index("Exchange")  # the exchange lies below
    assert laid.rdd.getNumPartitions() == 5
    cols = ["index_name", "term", "doc_id", "tf", "dl", "positions"]
    assert sorted(map(tuple, laid.select(cols).collect())) == sorted(map(tuple, build_postings(c).select(cols).collect()))


def test_shards_follow_the_corpus_and_signatures_are_not_stored(spark, tmp_path):
    assert shards_for(spark, 1 << 30) >= 200   # a task sorts and scores 5 MB of corpus at most
    SearchIndex.build(corpus(spark)).save(str(tmp_path / "i"), 3)
    assert sorted(os.listdir(tmp_path / "i")) == ["corpus_stats", "doc_stats", "layout", "postings", "term_stats"]


def test_scores_meet_the_mapping_without_exchange(spark, tmp_path):
    index = SearchIndex.build(corpus(spark)).save(str(tmp_path / "j"), 3)
    rows = [("a", i, i, "en" if i % 2 else "de", "uuid", f"u{i}") for i in range(0, 40, 4)] + [
        ("b", i, i, "en", "url", f"v{i}") for i in range(40)]
    mapping = save_by_document(spark.createDataFrame(rows, MAPPING).repartition(3, "doc_id"),
                               str(tmp_path / "j" / "doc_meta"), 3, ["doc_id"])
    reqs = spark.createDataFrame([(1, "a", "beta", 9)], REQUEST).withColumn("lang", F.lit("DE"))
    hits = result_hits(evaluate(clauses_from_q(reqs), index, kinds={"term"}, n_clauses=1), reqs, mapping, 1)
    joined = plan(hits, "simple")
    assert "ShuffledHashJoin" in joined and not [
        ln for ln in joined.splitlines() if "Exchange" in ln and "hashpartitioning(doc_id" in ln]
    assert sorted(r.doc_id for r in hits.collect()) == list(range(0, 40, 4))
    assert sorted(r.doc_id for r in askable(mapping, reqs).collect()) == list(range(0, 40, 4))


def test_wide_patterns_are_looked_up_in_the_documents(spark, tmp_path):
    """A prefix, ``x.*`` and a range match without listing their terms, also
    where requests share an id."""
    index = SearchIndex.build(corpus(spark)).save(str(tmp_path / "k"), 3)
    ask = [(1, "a", "al*", 9), (2, "a", "/gamma.*/ ta?2", 9), (3, "b", "[alpha1 TO alpha19]", 9),
           (4, "a", "{beta TO *}^3", 9), (5, "b", "al*^2", 9), (5, "b", "al*", 9)]
    clauses = clauses_from_q(spark.createDataFrame(ask, REQUEST))
    got = {(r.request_id, r.doc_id): r.score for r in evaluate(
        clauses, index, kinds={"prefix", "wildcard", "regex", "range"}).collect()}
    want = {(1, i): 1.0 for i in range(40)} | {(2, i): 1.0 + (i % 3 == 2) for i in range(40)}
    want |= {(3, i): 1.0 for i in range(40) if "alpha1" <= f"alpha{i}" <= "alpha19"}
    want |= {(4, i): 3.0 for i in range(40)} | {(5, i): 2.0 for i in range(40)}
    assert got == want
    text = plan(evaluate(clauses, index, kinds={"prefix", "range"}), "simple")
    assert not re.search(r"hashpartitioning\(index_name#\d+, term", text)  # no postings are dealt by term


def test_ranges_place_a_document_once_among_their_bounds(spark, tmp_path, monkeypatch):
    """Every kind of bound against brute force; a document's terms are not tried
    range by range."""
    from ranklake.operators import ranges
    monkeypatch.setattr(ranges, "CELLS", 40)
    rows = [(name, i, str(i), " ".join(w for k, w in enumerate(["b", "bb", "c", "é", "漢", "𝛼x", "a1"]) if (i >> k) & 1)) for i in range(128) for name in ("a", "b")]
    index = SearchIndex.build(spark.createDataFrame(rows, "index_name string, doc_id long, doc_key string, text string")).save(str(tmp_path / "r"), 3)
    bounds = ["*", "a1", "b", "ba", "bb", "é", "漢", "𝛼x", "zz"]
    asked = [(lo, up, brackets) for lo in bounds for up in bounds for brackets in ("[]", "{}")]
    clauses = clauses_from_q(spark.createDataFrame(
        [(n, "a" if n % 3 else "b", f"{x[0]}{lo} TO {up}{x[1]}^2", 9) for n, (lo, up, x) in enumerate(asked)], REQUEST))
    scores = evaluate(clauses, index, kinds={"range"})

    def inside(t, lo, up, x):
        below = lo == "*" or (t >= lo if x == "[]" else t > lo)
        return below and (up == "*" or (t <= up if x == "[]" else t < up))
    want = {(n, i) for n, (lo, up, x) in enumerate(asked) for _, i, _, text in rows[::2] if any(inside(t, lo, up, x) for t in text.split())}
    got = {(r.request_id, r.doc_id): r.score for r in scores.collect()}
    assert set(got) == want and set(got.values()) == {2.0}
    assert "lambdafunction" not in plan(scores, "extended")
    # too many ranges to be sent to the tasks
    few = clauses.where("request_id < 20")
    again = evaluate(few, index, kinds={"range"}, max_rows=3)
    assert {(r.request_id, r.doc_id) for r in again.collect()} == {(n, i) for n, i in want if n < 20}


def test_wildcards_of_every_form(spark, tmp_path):
    import fnmatch
    words = ["a", "ab", "abc", "abd", "abcd", "b", "bé", "béc", "漢字", "漢x字", "𝛼", "𝛼b", "xab"]
    index = SearchIndex.build(spark.createDataFrame([("a", i, str(i), w) for i, w in enumerate(words)],
                                                    "index_name string, doc_id long, doc_key string, text string")).save(str(tmp_path / "w"), 2)
    forms = ["a?", "a?c", "a*c", "a*?", "ab?d", "b?c", "b*", "漢?字", "漢?", "𝛼?", "?", "a??", "a*b*d"]
    forms = [f for f in forms if f != "?"]
    clauses = clauses_from_q(spark.createDataFrame([(n, "a", f, 9) for n, f in enumerate(forms)], REQUEST))
    got = {(r.request_id, r.doc_id) for r in evaluate(clauses, index, kinds={"prefix", "wildcard"}).collect()}
    assert got == {(n, i) for n, f in enumerate(forms) for i, w in enumerate(words) if fnmatch.fnmatchcase(w, f)}
