"""Requests answered block by block give the rows of full scoring; rows of their own."""

import random

import pytest
from pyspark.sql import functions as F

from ranklake.operators import blocks
from ranklake.operators.enrich import result_hits
from ranklake.operators.postings import SearchIndex
from ranklake.operators.query import clauses_from_q
from ranklake.operators.scoring import evaluate, topk_hits
from ranklake.plans import search as plans

CORPUS = "index_name string, doc_id long, doc_key string, text string"
MAPPING = "index_name string, doc_id long, file_pos long, language string, mode string, out_url string"
RECORDS = "index_name string, file_pos long, id string, title string, textSnippet string, language string, warcDate string, wordCount int"
REQUESTS = "request_id string, q string, index string, lang string, ranking string, limit int"
QUERIES = ["the of w1 w2 w30 w40", "the", "w500 w90 the of", "the of the of w1^3 w2", "nothing here", "w7 w8 w9 w10 w11",
           "+the w3", "w4 -of", "of^0 w2", "+of +w1 the", "-the", "w1*", "of w6~1", '"the of"', "+the +the w2", "the -nothing"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    out = []
    for i in range(240):
        words = ["the", "of"] * rng.randrange(0, 4) + [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(0, 25))]
        out.append(out[-1] if i % 7 == 3 else " ".join(words))
    return out


@pytest.fixture(scope="module")
def index(spark, texts, tmp_path_factory):
    """Index ``b`` is without metadata; some documents are stored twice."""
    rows = [("a" if i % 3 else "b", i, str(i), t) for i, t in enumerate(texts)] + [("a", 1, "1", texts[1]), ("a", 2, "2", "the w1 other")]
    return SearchIndex.build(spark.createDataFrame(rows, CORPUS)).save(str(tmp_path_factory.mktemp("index") / "i"), 4)


@pytest.fixture(scope="module")
def tables(spark, texts):
    """Several records a document, some without language, some twice."""
    of_a = [(i, 10 * i + k) for i in range(len(texts)) if i % 3 and i % 5 for k in range(1 + i % 2)]
    lang = lambda n: [None, "en", "EN", "de"][n % 4]
    mapping = [("a", i, n, lang(i + n), "url", f"u{n}") for i, n in of_a] + [("b", i, -1, None, "bare", f"k{i}") for i in range(0, len(texts), 3)]
    records = [("a", n, str(i), f"t{n}", f"s{n}\n" * (n % 3), lang(i + n), None, n % 11) for i, n in of_a]
    return spark.createDataFrame(mapping + mapping[5:7], MAPPING), spark.createDataFrame(records + records[9:11], RECORDS)


def requests(spark):
    rows = [(f"r{k}-{lim}", q, "a" if k % 4 else "b", [None, "en", "DE", "xx"][(k + lim) % 4], [None, "asc", "desc"][k % 3], lim)
            for k, q in enumerate(QUERIES) for lim in (1, 15, 400)]
    rows += [("twice", "the w1", "a", "en", None, 9)] * 2 + [("langs", "the w1", "a", "en", None, 9), ("langs", "of", "a", "de", "asc", 9)]
    rows += [("limits", "the", "a", None, None, 3), ("limits", "the", "a", None, None, 5), (None, "the", "a", None, None, 5)]
    return spark.createDataFrame(rows, REQUESTS)


def test_same_results_as_full_scoring(spark, index, tables):
    mapping, records = tables
    # The record column is only there to see that it comes with its record.
    fields = {"shout": F.upper("textSnippet")}
    # a table of metadata is asked for the names of its indexes only
    metadata = spark.createDataFrame([("a",)], "index_name string")
    rows = {}
    for way in (False, True):
        out = plans.search(requests(spark), index, metadata, "a", mapping=mapping, records=records, blocks=way, record_fields=fields)
        rows[way] = sorted(map(tuple, out.results.collect()), key=repr)
    # Copies of a row have the ranks of their group in any order.
    assert rows[True] == rows[False] and len(rows[True]) > 500
    assert {r[0] for r in rows[True]} >= {"twice", "langs", "limits", "r11-15", "r6-400", "r7-1"}


@pytest.mark.parametrize(("max_rows", "group"), [(1_000_000, 150), (0, 4_000_000)])
def test_groups_and_shuffled_sides(spark, index, tables, monkeypatch, max_rows, group):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 500)
    mapping, _ = tables
    valid = requests(spark).withColumnRenamed("index", "index_name").where("request_id LIKE 'r%'")
    plain = blocks.plain_requests(valid, blocks.said(clauses_from_q(valid)))
    assert {r.request_id for r in valid.join(plain, "request_id", "left_anti").collect()} == {
        f"r{k}-{n}" for k in (11, 12, 13) for n in (1, 15, 400)}
    valid = valid.join(plain, "request_id", "left_semi").checkpoint()
    clauses = clauses_from_q(valid)
    numbered = blocks.numbered_rows(mapping, valid)
    got = blocks.block_topk(valid, blocks.said(clauses), index, numbered, 400, max_rows, group).select("request_id", F.posexplode("rows").alias("pos", "row"))
    got = got.join(numbered, "row").select("request_id", (F.col("pos") + 1).alias("rank"), "doc_id", "file_pos", "out_url")
    want = topk_hits(result_hits(evaluate(clauses, index), valid, mapping, 1), 400, [F.col("file_pos")])
    want = want.select("request_id", "rank", "doc_id", "file_pos", "out_url")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_many_requests_are_answered_without_a_row_per_document(spark, index, tables, monkeypatch):
    """Full scoring sends the best rows of every shard, which for many requests
    is their product with the documents."""
    mapping, records = tables
    metadata = spark.createDataFrame([("a",)], "index_name string")
    asked = spark.createDataFrame([(f"r{i}", f"the of w{i}", "a", None, None, 20) for i in range(40)], REQUESTS)
    want = plans.search(asked, index, metadata, "a", mapping=mapping, records=records).results.collect()
    monkeypatch.setattr(plans, "BLOCK_MIN_REQUESTS", 40, raising=False)
    monkeypatch.setattr(plans, "BLOCK_MIN_ROWS", 800, raising=False)
    monkeypatch.setattr(plans, "topk_hits", None)
    got = plans.search(asked, index, metadata, "a", mapping=mapping, records=records).results
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) >= 800
    none = plans.search(asked.limit(0), index, metadata, "a", mapping=mapping, records=records, blocks=True).results
    assert none.count() == 0
