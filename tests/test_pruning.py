"""Pruned top-k gives the rows of full scoring, and reads fewer postings."""

import random

import pytest
from pyspark.sql import functions as F

from ranklake.operators import pruning
from ranklake.operators.postings import SearchIndex
from ranklake.operators.query import clauses_from_q
from ranklake.operators.scoring import evaluate, topk_hits


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """Frequent words in every text, rarer ones in some, exact copies, and a
    second index."""
    rng = random.Random(11)
    texts = []
    for i in range(400):
        words = ["the", "of"] * rng.randrange(1, 4) + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(3, 30))]
        texts.append(texts[-1] if i % 7 == 3 else " ".join(words))
    rows = [("a" if i % 3 else "b", i, str(i), t) for i, t in enumerate(texts)]
    corpus = spark.createDataFrame(rows, "index_name string, doc_id long, doc_key string, text string")
    return SearchIndex.build(corpus).save(str(tmp_path_factory.mktemp("index") / "i"), 4)


QUERIES = ["the of w1 w2 w30 w40", "the", "w500 w90 the of", "the of the of w1^3 w2", "nothing here", "w7 w8 w9 w10 w11", "+the w3", "w4 -of", "w1*", "of w6~1"]


def _clauses(spark, limits=(1, 20, 400)):
    rows = [(f"r{k}-{lim}", "a" if k % 4 else "b", lim, q) for k, q in enumerate(QUERIES) for lim in limits]
    return clauses_from_q(spark.createDataFrame(rows, "request_id string, index_name string, limit int, q string")).persist(), len(rows)


@pytest.mark.parametrize(("split", "filtered"), [(0.1, True), (0.5, False)])
def test_same_rows_as_full_scoring(spark, index, split, filtered):
    clauses, n = _clauses(spark)
    keep = (lambda s: s.filter(F.col("doc_id") % 5 != 2)) if filtered else (lambda s: s)
    want = topk_hits(keep(evaluate(clauses, index)), 400)
    got = pruning.pruned_topk(clauses, index, 400, clauses.count(), n, keep, split=split)
    cols = ["request_id", "index_name", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_shuffled_sides_and_no_clauses(spark, index):
    clauses, n = _clauses(spark, (3,))
    want = topk_hits(evaluate(clauses, index), 3).select("request_id", "rank", "doc_id", "score")
    got = pruning.pruned_topk(clauses, index, 3, clauses.count(), n, max_rows=2).select("request_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert pruning.pruned_topk(clauses.limit(0), index, 3, 0, 0, kinds={"term"}).count() == 0


def test_rest_holds_the_long_posting_lists(spark, index):
    """The scored terms have fewer postings than all terms, and what is left
    out cannot gain more than the bound says."""
    clauses, _ = _clauses(spark, (3,))
    plain = clauses.filter("kind = 'term' AND occur = 'SHOULD'")
    b = pruning.term_bounds(plain, index, 0.3).join(index.term_stats, ["index_name", "term"])
    rows = b.collect()
    assert sum(r.df for r in rows if r.scored) < sum(r.df for r in rows)
    assert any(r.rest > 0 for r in rows)
    for r in rows:
        assert r.rest == pytest.approx(sum(x.weight * x.max_impact for x in rows if x.request_id == r.request_id and not x.scored))
    top = index.postings.filter("term = 'the' AND index_name = 'a'").join(F.broadcast(index.corpus_stats), "index_name")
    from ranklake.functions.bm25 import tf_norm
    best = top.agg(F.max(tf_norm("tf", F.col("dl"), "avgdl"))).first()[0]
    assert index.term_stats.filter("term = 'the' AND index_name = 'a'").first().max_impact == pytest.approx(best)


def test_plan_scores_only_asked_terms(spark, index, capsys):
    """No window over all documents and no exchange below the score sum."""
    clauses, n = _clauses(spark, (3,))
    plain = clauses.filter("kind = 'term' AND occur = 'SHOULD'")
    df = pruning.pruned_topk(plain, index, 3, plain.count(), n, kinds={"term"})
    df.explain("formatted")
    plan = capsys.readouterr().out
    assert "WindowGroupLimit" in plan and "positions" not in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
