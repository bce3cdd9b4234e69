"""Inverted index as Spark tables.

* ``postings(index_name, term, doc_id, tf, dl, positions)``: one row per
  (term, document); ``dl`` is carried on every posting so BM25 needs no join
  with the document table, and ``positions`` (0-based, sorted) serve phrase
  queries. Parquet column pruning keeps ``positions`` out of plain scoring.
* ``doc_stats(index_name, doc_id, doc_key, dl)``: stored key (URL or UUID).
* ``term_stats(index_name, term, df, max_impact)``: ``max_impact`` is the
  largest tf-norm of the term's postings, the bound that pruned top-k needs.
* ``signatures(index_name, sig, term, df)``: every term under its deletion
  signatures, for fuzzy matching by an equi-join. Tens of rows a term, so they
  are made of ``term_stats`` by the searches that ask for them, not stored.
* ``corpus_stats(index_name, n_docs, sum_dl, avgdl)``: one row per index,
  so its size is bounded by the number of indexes and it is broadcast.

Stored layout: postings bucketed by document and sorted by (index, term)
inside a bucket. A term that a third of all documents hold is spread over all
buckets, and whatever sums per document (document lengths, the scores of plain
requests) finds its rows in one place without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.config import MAX_SHARDS, SHARD_BYTES
from ranklake.functions.bm25 import tf_norm
from ranklake.functions.text import DEFAULT_ANALYSER, exploded_signatures, tokens
from ranklake.operators.partitioning import dealt_to, spread


def _sorted_pairs(toks):
    """(term, position) pairs of a token array, sorted by term then position."""
    # sort_array compares with a direct ordering; array_sort would call a
    # lambda comparator per comparison.
    return F.sort_array(F.transform(toks, lambda x, i: F.struct(x.alias("term"), i.alias("pos"))))


def _run_starts(pairs):
    """1-based indexes where a new term starts in the sorted pairs."""
    def term_at(i):
        return F.element_at(pairs, i).getField("term")
    return F.filter(F.sequence(F.lit(1), F.size(pairs)),
                    lambda i: (i == 1) | (term_at(i) != term_at(F.greatest(i - 1, F.lit(1)))))


def _runs(pairs, starts):
    """One ``struct(term, tf, positions)`` per run of equal terms."""
    n = F.size(pairs)

    def run(a, k):
        b = F.when(k + 1 < F.size(starts), F.element_at(starts, k + 2) - 1).otherwise(n)
        return F.struct(F.element_at(pairs, a).getField("term").alias("term"),
                        (b - a + 1).alias("tf"),
                        F.transform(F.slice(pairs, a, b - a + 1),
                                    lambda x: x.getField("pos")).alias("positions"))

    empty = F.array().cast("array<struct<term:string,tf:int,positions:array<int>>>")
    return F.when(n > 0, F.transform(starts, run)).otherwise(empty)


def build_postings(corpus: DataFrame, text_col: str = "text", analyser: str = DEFAULT_ANALYSER,
                   shards: int | None = None) -> DataFrame:
    """corpus(index_name, doc_id, text) -> postings, with ``shards`` in so many
    partitions by document.

    A document is one row, so its postings are computed inside the row and
    exploded: sort the (term, position) pairs, find where the term changes,
    slice out each run. Building the postings is a map-only step; what is
    shuffled are the texts, before (a text takes a fraction of its postings'
    bytes). Each step reads the previous one's column: an
    expression referenced inside a lambda would be evaluated once per
    element, a column once per row."""
    rows = corpus.select("doc_id", text_col, F.struct("index_name").alias("of"))
    # A text that a document has in several indexes is analysed once; the rows
    # of a document lie in one partition, so nothing else is shuffled.
    docs = (rows.repartition(shards, "doc_id").groupBy("doc_id", text_col).agg(F.collect_list("of").alias("of"))
            if shards else spread(rows).withColumn("of", F.array("of")))
    docs = (docs.select("of", "doc_id", tokens(text_col, analyser).alias("toks"))
            .select("of", "doc_id", F.size("toks").cast("long").alias("dl"),
                    _sorted_pairs(F.col("toks")).alias("pairs"))
            .select("of", "doc_id", "dl", "pairs",
                    F.when(F.size("pairs") > 0, _run_starts(F.col("pairs")))
                    .otherwise(F.array().cast("array<int>")).alias("starts")))
    return (docs.select("of", "doc_id", "dl",
                        F.explode(_runs(F.col("pairs"), F.col("starts"))).alias("p"))
            .select(F.explode("of").alias("of"), "doc_id", "dl", "p")
            .select(F.col("of.index_name").alias("index_name"), F.col("p.term").alias("term"), "doc_id",
                    F.col("p.tf").cast("long").alias("tf"), "dl",
                    F.col("p.positions").alias("positions")))


def doc_lengths(postings: DataFrame) -> DataFrame:
    """(index_name, doc_id, dl) for documents with at least one token, the
    documents BM25 counts."""
    return postings.groupBy("index_name", "doc_id").agg(F.max("dl").alias("dl"))


def build_term_stats(postings: DataFrame, corpus_stats: DataFrame) -> DataFrame:
    """df and the largest BM25 tf-norm of every term. ``corpus_stats`` has one
    row per index, so it is broadcast."""
    impact = tf_norm("tf", F.col("dl"), "avgdl")
    return (postings.select("index_name", "term", "tf", "dl")
            .join(F.broadcast(corpus_stats.select("index_name", "avgdl")), "index_name")
            .groupBy("index_name", "term")
            .agg(F.count(F.lit(1)).cast("long").alias("df"), F.max(impact).alias("max_impact")))


def build_signatures(term_stats: DataFrame) -> DataFrame:
    """Terms by deletion signature: bounded rows a term."""
    return exploded_signatures(term_stats.select("index_name", "term", "df"), "term")


def build_corpus_stats(doc_stats: DataFrame) -> DataFrame:
    return (doc_stats.groupBy("index_name")
            .agg(F.count(F.lit(1)).cast("long").alias("n_docs"),
                 F.sum("dl").cast("long").alias("sum_dl"))
            .withColumn("avgdl", F.col("sum_dl") / F.col("n_docs")))


@dataclass
class SearchIndex:
    """The four tables of one or more named indexes."""

    postings: DataFrame
    doc_stats: DataFrame
    term_stats: DataFrame
    corpus_stats: DataFrame
    keys: DataFrame | None = None   # corpus (index_name, doc_id, doc_key), build only
    layout: Callable[[int], DataFrame] | None = None   # postings in so many partitions by document, build only
    analyser: str = DEFAULT_ANALYSER   # of its texts, and of the queries that it answers
    shards: int | None = None   # of the stored postings

    def by_signature(self) -> DataFrame:
        return build_signatures(spread(self.term_stats))

    @classmethod
    def build(cls, corpus: DataFrame, text_col: str = "text", analyser: str = DEFAULT_ANALYSER) -> "SearchIndex":
        """Lazy build from corpus(index_name, doc_id, doc_key, text)."""
        postings = build_postings(corpus, text_col, analyser)
        lengths = doc_lengths(postings)
        keys = corpus.select("index_name", "doc_id", "doc_key")
        doc_stats = lengths.join(keys, ["index_name", "doc_id"], "inner")
        corpus_stats = build_corpus_stats(lengths)
        return cls(postings, doc_stats, build_term_stats(postings, corpus_stats), corpus_stats, keys,
                   lambda shards: build_postings(corpus, text_col, analyser, shards), analyser)

    def save(self, path: str, shards: int | None = None) -> "SearchIndex":
        """Write the tables once (the one-off index build) and return the
        index read back from storage. Later tables are derived from the
        written postings, so the corpus is tokenised once.

        Postings are sharded by document (bucketed by ``doc_id``, sorted by
        index and term inside a shard): a frequent term's postings lie in all
        shards, and the score sum per (request, document) needs no exchange.
        ``shards`` defaults to one per core; give more for a large corpus
        (``shards_for``)."""
        spark = self.postings.sparkSession
        shards = shards or spark.sparkContext.defaultParallelism
        with dealt_to(spark, shards):
            return self._write(spark, path, shards)

    def _write(self, spark: SparkSession, path: str, shards: int) -> "SearchIndex":
        rows = self.layout(shards) if self.layout is not None else self.postings.repartition(shards, "doc_id")
        stored = save_by_document(rows, f"{path}/postings", shards, ["index_name", "term"])
        spark.createDataFrame([(shards, self.analyser)], "shards int, analyser string").write.mode("overwrite").parquet(f"{path}/layout")
        lengths = doc_lengths(stored)
        keys = (self.keys if self.keys is not None
                else self.doc_stats.select("index_name", "doc_id", "doc_key"))
        (lengths.join(keys, ["index_name", "doc_id"], "inner")
         .write.mode("overwrite").partitionBy("index_name").parquet(f"{path}/doc_stats"))
        (build_corpus_stats(spark.read.parquet(f"{path}/doc_stats"))
         .write.mode("overwrite").parquet(f"{path}/corpus_stats"))
        (build_term_stats(stored, spark.read.parquet(f"{path}/corpus_stats"))
         .write.mode("overwrite").partitionBy("index_name").parquet(f"{path}/term_stats"))
        return SearchIndex.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "SearchIndex":
        shards, analyser = spark.read.schema("shards int, analyser string").parquet(f"{path}/layout").first()
        return cls(load_by_document(spark, f"{path}/postings", shards, ["index_name", "term"]),
                   spark.read.parquet(f"{path}/doc_stats"),
                   spark.read.parquet(f"{path}/term_stats"),
                   spark.read.parquet(f"{path}/corpus_stats"),
                   analyser=analyser or DEFAULT_ANALYSER, shards=shards)


def _table_name(path: str, what: str = "postings") -> str:
    """The catalog name of what is stored under ``path`` (the catalog
    keeps the bucketing; the files are plain Parquet)."""
    return f"ranklake_{what}_{zlib.crc32(path.encode()):08x}"


def save_by_document(rows: DataFrame, path: str, shards: int, sort: list[str]) -> DataFrame:
    """Writes rows that lie in ``shards`` partitions by ``doc_id`` as so many
    buckets; the last part of ``path`` names them in the catalog."""
    root, _, what = path.rpartition("/")
    name = _table_name(root, what)
    (rows.write.mode("overwrite").bucketBy(shards, "doc_id").sortBy(*sort)
     .option("path", path).saveAsTable(name))
    return rows.sparkSession.table(name)


def load_by_document(spark: SparkSession, path: str, shards: int, sort: list[str]) -> DataFrame:
    """What ``save_by_document`` wrote, also in another session."""
    root, _, what = path.rpartition("/")
    name = _table_name(root, what)
    if not spark.catalog.tableExists(name):  # written by another session
        fields = spark.read.parquet(path).schema.fields
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet LOCATION '{path}' "
                  f"CLUSTERED BY (doc_id) SORTED BY ({', '.join(sort)}) INTO {shards} BUCKETS")
    return spark.table(name)


def shards_for(spark: SparkSession, input_bytes: int) -> int:
    """Document shards for a corpus of so many (compressed) bytes: about
    ``SHARD_BYTES`` of it each, and at least one per core. From some 6 TB on
    there are ``MAX_SHARDS`` and each holds more: a shard's rows are sorted by
    term, so what a scan of it reads follows the query's terms."""
    return min(MAX_SHARDS, max(spark.sparkContext.defaultParallelism, -(-input_bytes // SHARD_BYTES)))


def index_registry(index: SearchIndex) -> DataFrame:
    """One row per known index name."""
    return index.corpus_stats.select("index_name").distinct()
