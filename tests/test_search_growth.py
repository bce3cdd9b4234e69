"""What a search keeps and moves does not grow faster than its input; rows of its own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ranklake.functions.text import deletion_signatures, exploded_signatures
from ranklake.operators import postings
from ranklake.operators.partitioning import dealt_to
from ranklake.operators.postings import SearchIndex
from ranklake.operators.query import clauses_from_q
from ranklake.operators.scoring import evaluate
from ranklake.plans import search as plans
from test_plans import plan

REQUEST = "request_id long, index_name string, q string, limit int"
CORPUS = "index_name string, doc_id long, doc_key string, text string"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return [" ".join(rng.choice(["a", "b", "c", "abc", "abd"]) for _ in range(rng.randrange(0, 25))) for _ in range(60)]


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    rows = [(name, i, str(i), t) for i, t in enumerate(texts) for name in ("i", "j")]
    return SearchIndex.build(spark.createDataFrame(rows, CORPUS)).save(str(tmp_path_factory.mktemp("index") / "g"), 3)


def ask(spark, *queries):
    return clauses_from_q(spark.createDataFrame([(n, "i", q, 9) for n, q in enumerate(queries)], REQUEST))


def test_phrases_of_every_length_stay_in_their_shard(spark, index, texts):
    phrases = ["b", "a b", "a a", "a b c", "a a a", "a b a b", "c abc b a a", "a zzz b"]
    want = {(n, i) for n, p in enumerate(phrases) for i, t in enumerate(texts) if f" {p} " in f" {t} "}
    clauses = ask(spark, *[f'"{p}"' for p in phrases])
    for rows in (1_000_000, 0):
        scores = evaluate(clauses, index, kinds={"phrase"}, max_rows=rows)
        assert {(r.request_id, r.doc_id) for r in scores.collect()} == want
        if rows:  # no postings, and nothing of a document, are dealt out
            assert not re.search(r"hashpartitioning\([^)]*(doc_id|term|pos|start)#", plan(scores, "simple"))


def test_phrase_frequency_counts_overlapping_places(spark, tmp_path):
    rows = [("i", 1, "1", "a a a a"), ("i", 2, "2", "a a b b")]
    index = SearchIndex.build(spark.createDataFrame(rows, CORPUS)).save(str(tmp_path / "f"), 2)
    got = {r.doc_id: r.score for r in evaluate(ask(spark, '"a a"'), index, kinds={"phrase"}).collect()}
    assert got[1] / got[2] == pytest.approx((3 / 4.2) / (1 / 2.2), rel=1e-4)


def test_signatures_are_the_same_rows_without_lambdas(spark):
    words = spark.createDataFrame([(w,) for w in ["a", "ab", "aab", "abcdefgh", "abcdefghij", "é漢", "aaaaaaaa"]], "w string")
    listed = {r.w: set(r.s) for r in words.select("w", deletion_signatures("w").alias("s")).collect()}
    rows = exploded_signatures(words, "w")
    assert {r.w: set(r.s) for r in rows.groupBy("w").agg(F.collect_set("sig").alias("s")).collect()} == listed
    assert "lambda" not in plan(rows, "extended")


def test_fuzzy_clauses_of_a_term_are_one_weight(spark, index):
    """Optional clauses are summed before the postings are read; required ones
    are still met one by one."""
    one = evaluate(ask(spark, "abc~1"), index, kinds={"fuzzy"})
    twice = evaluate(ask(spark, "abc~1 abc~1"), index, kinds={"fuzzy"})
    assert "clause_no" not in plan(twice, "simple").split("Scan parquet")[0]
    single = {r.doc_id: r.score for r in one.collect()}
    assert single and {r.doc_id: r.score for r in twice.collect()} == pytest.approx({d: 2 * s for d, s in single.items()}, abs=2e-6)
    both = evaluate(ask(spark, "+abc~1 +b~0 -c~0"), index, kinds={"fuzzy"})
    got = {r.doc_id for r in both.collect()}
    assert got == {r.doc_id for r in evaluate(ask(spark, "+abc~1 +b -c"), index).collect()} and got


def test_stored_postings_are_not_scored_by_bounds(spark, index, monkeypatch):
    """The passes store every partial score; full scoring stays in the shards."""
    reqs = spark.createDataFrame([(1, "a abd", "i", None, None, 5)], "request_id long, q string, index string, lang string, ranking string, limit int")
    rows = lambda **kw: sorted((r.rank, r.url) for r in plans.search(reqs, index, None, "i", **kw).results.collect())
    bounds = rows(prune=True)
    monkeypatch.setattr(plans, "PRUNE_RATIO", 0)
    monkeypatch.setattr(plans, "pruned_topk", None)
    assert rows() == bounds and len(bounds) == 5


def test_stored_tables_are_dealt_to_as_many_tasks_as_shards(spark, texts, tmp_path, monkeypatch):
    seen = []
    monkeypatch.setattr(postings, "build_term_stats", lambda p, c, build=postings.build_term_stats: (
        seen.append(spark.conf.get("spark.sql.shuffle.partitions")), build(p, c))[1])
    built = SearchIndex.build(spark.createDataFrame([("i", 1, "1", "a b")], CORPUS))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    built.save(str(tmp_path / "s"), 23)
    assert seen[-1] == "23" and spark.conf.get("spark.sql.shuffle.partitions") == before
    with pytest.raises(ZeroDivisionError), dealt_to(spark, 40):
        raise ZeroDivisionError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
