"""Stored embedding memo, folder of indexes, index layout, part-file metadata."""

import re

import pytest
from pyspark.sql import functions as F

from ranklake.config import MAX_SHARDS, SHARD_BYTES
from ranklake.operators.folder import IndexFolder, saved_indexes
from ranklake.operators.memo import EmbeddingMemo
from ranklake.operators.postings import SearchIndex, shards_for
from ranklake.operators.query import plain_clauses
from ranklake.operators.requests import retriever_requests
from ranklake.operators.scoring import evaluate
from ranklake.sources.metadata import scan_metadata_dir, write_metadata


def texts_of(spark, *values):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, text string")


def vectors(df):
    return {r.id: (r.vec and list(r.vec)) for r in df.collect()}


def logging_model(path):
    """A model that writes down what it is given (it runs in other processes)."""
    def model(texts):
        with open(path, "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return [[len(t), 1.0] for t in texts]
    return model


def test_memo_embeds_a_text_once(spark, tmp_path):
    memo, log = EmbeddingMemo(spark, str(tmp_path / "memo")), tmp_path / "log"
    model = logging_model(str(log))
    first = vectors(memo.embed(texts_of(spark, "a", "bb", "a", None, ""), model))
    assert first == {0: [1, 1], 1: [2, 1], 2: [1, 1], 3: None, 4: [0, 1]}
    assert sorted(log.read_text().split("\n")[:-1]) == ["", "a", "bb"]
    log.write_text("")
    again = EmbeddingMemo(spark, str(tmp_path / "memo"))
    assert vectors(again.embed(texts_of(spark, "bb", "ccc"), model)) == {0: [2, 1], 1: [3, 1]}
    assert log.read_text() == "ccc\n"
    log.write_text("")
    assert vectors(again.embed(texts_of(spark, "ccc"), model)) == {0: [3, 1]} and log.read_text() == ""
    assert again.embed(texts_of(spark), model).count() == 0


def test_memo_keeps_the_batches_that_went_well(spark, tmp_path):
    memo = EmbeddingMemo(spark, str(tmp_path / "memo"))

    def failing(texts):
        if "bad" in texts:
            raise RuntimeError("no answer")
        return [[float(len(t))] for t in texts]
    words = [f"w{k}" for k in range(40)] + ["bad"]
    rows = memo.embed(texts_of(spark, *words), failing, batch_texts=1, task_texts=8).collect()
    assert len(rows) == 41
    assert [(r.text, r.error) for r in rows if r.vec is None] == [("bad", "RuntimeError: no answer")]
    assert memo.stored().count() == 40
    rows = memo.embed(texts_of(spark, *words), lambda t: [[float(len(x))] for x in t]).collect()
    assert all(r.vec is not None and r.error is None for r in rows) and memo.stored().count() == 41
    short = EmbeddingMemo(spark, str(tmp_path / "other")).embed(texts_of(spark, "x", "y"), lambda t: [[1.0]]).collect()
    assert [r.error for r in short] == ["ValueError: 1 vectors for 2 texts"] * 2


def corpus_of(spark, name, *texts):
    return spark.createDataFrame([(name, k, str(k), t) for k, t in enumerate(texts)],
                                 "index_name string, doc_id long, doc_key string, text string")


def test_folder_of_indexes(spark, tmp_path):
    folder = str(tmp_path)
    one, two = corpus_of(spark, "one", "red fox", "red hen", "blue sky"), corpus_of(spark, "two", "red sea", "fox and hen")
    SearchIndex.build(one).save(f"{folder}/first", 3)
    reqs = spark.createDataFrame([(1, "one", 9, "red fox"), (2, "two", 9, "red fox"), (3, "none", 9, "red")],
                                 "request_id long, index_name string, limit int, q string")
    clauses = plain_clauses(reqs)
    opened = IndexFolder.open(spark, folder)
    assert {r.request_id for r in opened.evaluate(clauses, kinds={"term"}).collect()} == {1}
    SearchIndex.build(two).save(f"{folder}/second", 5)  # another number of shards
    assert len(saved_indexes(spark, folder)) == 2
    opened = IndexFolder.open(spark, folder)
    assert {r.index_name for r in opened.registry(spark).collect()} == {"one", "two"}
    got = opened.evaluate(clauses, kinds={"term"})
    whole = evaluate(clauses, SearchIndex.build(one.unionByName(two)), kinds={"term"})
    row = lambda r: (r.request_id, r.index_name, r.doc_id, round(r.score, 6))
    assert sorted(map(row, got.collect())) == sorted(map(row, whole.collect())) != []
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "doc_id" in plan and not re.search(r"Exchange hashpartitioning\([^)]*doc_id", plan)
    assert opened.evaluate(plain_clauses(reqs.filter("request_id = 3")), kinds={"term"}) is None
    SearchIndex.build(one).save(f"{folder}/third", 2)
    with pytest.raises(ValueError, match="index one"):
        IndexFolder.open(spark, folder)
    assert IndexFolder.open(spark, str(tmp_path / "nothing")).evaluate(clauses) is None


def test_shards_stay_within_the_bound_on_buckets(spark):
    cores = spark.sparkContext.defaultParallelism
    assert shards_for(spark, 0) == cores
    assert shards_for(spark, 1000 * SHARD_BYTES) == 1000
    assert shards_for(spark, 100 << 40) == MAX_SHARDS == 100_000


def test_retriever_defaults(spark):
    rows = spark.createDataFrame([("q", None, None, None, None), ("q", "i", "de", "asc", 0)],
                                 "q string, index string, lang string, ranking string, limit int")
    got = [(r["index"], r.lang, r.ranking, r.limit) for r in retriever_requests(rows).collect()]
    assert got == [("demo-graz", "en", None, 100), ("i", "de", "asc", 0)]
    assert retriever_requests(rows, "x", None, 7).first()["lang"] is None


def test_metadata_in_parts(spark, tmp_path):
    """Records of a folder of parts keep their place over the parts; a plain
    file beside it is read as before."""
    cols = ["record_id", "url", "title", "plain_text", "language", "warc_date"]
    rows = spark.range(1000).select(F.col("id").alias("file_pos"), *[F.concat(F.lit(c[0]), "id").alias(c) for c in cols])
    write_metadata(rows.repartition(5), str(tmp_path / "many parts.parquet"), 4)
    assert len(list((tmp_path / "many parts.parquet").glob("part-*"))) > 1
    rows.limit(3).drop("file_pos").coalesce(1).write.parquet(str(tmp_path / "tmp"))
    next((tmp_path / "tmp").glob("part-*")).rename(tmp_path / "one.parquet")
    got = scan_metadata_dir(spark, str(tmp_path)).select("index_name", "id", "file_pos").collect()
    many = sorted((r.file_pos, r.id) for r in got if r.index_name not in ("one",))
    assert many == [(k, f"r{k}") for k in range(1000)]
    assert sorted(r.file_pos for r in got if r.index_name == "one") == [0, 1, 2]
    assert {r.index_name for r in got} == {"many parts", "one"}


def test_folder_of_two_analysers(spark, tmp_path):
    folder = str(tmp_path)
    texts = ("we can't stop at example.com", "we can stop", "pi is 3.14", "3 or 14", "東京 tower")
    SearchIndex.build(corpus_of(spark, "plain", *texts)).save(f"{folder}/plain", 2)
    SearchIndex.build(corpus_of(spark, "whole", *texts), analyser="uax29_like").save(f"{folder}/whole", 2)
    opened = IndexFolder.open(spark, folder)
    assert {n: i.analyser for i, held in zip(opened.indexes, opened.names) for n in held} == {"plain": "words", "whole": "uax29_like"}
    asked = ["can't", "3.14", "example", '"stop at example.com"', "京東"]
    reqs = spark.createDataFrame([(k * 2 + j, name, 9, q) for k, q in enumerate(asked) for j, name in enumerate(("plain", "whole"))],
                                 "request_id long, index_name string, limit int, q string")
    got: dict = {}
    for r in opened.answer(reqs).collect():
        got.setdefault(r.request_id, set()).add(r.doc_id)
    assert [got.get(k, set()) for k in range(10)] == [{0, 1}, {0}, {2, 3}, {2}, {0}, set(), {0}, {0}, set(), {4}]
    # another session finds the analyser where the index is stored
    assert SearchIndex.load(spark, f"{folder}/whole").analyser == "uax29_like"
