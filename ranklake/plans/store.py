"""Stored search tables for one input directory: index, canonical metadata
and the document-to-result mapping, written once as Parquet under the
shared ``spark.checkpoint.dir`` and read back by every query (a written
table cuts the lineage: no query re-tokenises the corpus)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ranklake.operators.enrich import (canonical_schema_a, canonical_schema_b, doc_meta,
                                       result_records)
from ranklake.operators.partitioning import dealt_to
from ranklake.operators.postings import SearchIndex, load_by_document, save_by_document, shards_for
from ranklake.session import ensure_checkpoint_dir, release, scratch_path
from ranklake.sources import fixtures as fx
from ranklake.sources.tables import read_table


@dataclass
class Store:
    root: str
    index: SearchIndex
    meta: DataFrame
    mapping: DataFrame
    records: DataFrame


_ROOTS: dict[tuple, str] = {}


def _files(spark: SparkSession, sf_dir: str, name: str) -> list[tuple]:
    """Path, size and modification time of every file of a table."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for file in read_table(spark, sf_dir, name).inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(file)
        st = path.getFileSystem(conf).getFileStatus(path)
        out.append((file, st.getLen(), st.getModificationTime()))
    return sorted(out)


def documents_size(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the documents' files, of which the number of shards is made."""
    return sum(n for _, n, _ in _files(spark, sf_dir, "documents"))


def _input_state(spark: SparkSession, sf_dir: str) -> tuple:
    """What the store is built of."""
    return tuple(f for name in ("documents", "pages") for f in _files(spark, sf_dir, name))


def _done(spark: SparkSession, root: str) -> bool:
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/_COMPLETE")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(path)


def _mark_done(spark: SparkSession, root: str) -> None:
    spark.createDataFrame([(1,)], "ok int").write.mode("overwrite").parquet(f"{root}/_COMPLETE")


def build_store(spark: SparkSession, sf_dir: str) -> Store:
    """Build (one-off) the stored tables of the fixture indexes of ``sf_dir``."""
    root = scratch_path(spark, "store")
    shards = shards_for(spark, documents_size(spark, sf_dir))
    with dealt_to(spark, shards):
        index = SearchIndex.build(fx.corpus(spark, sf_dir)).save(root, shards)
        meta = canonical_schema_a(fx.metadata_a(spark, sf_dir), fx.INDEX_UUID).unionByName(
            canonical_schema_b(fx.metadata_b(spark, sf_dir), fx.INDEX_URL))
        meta.write.mode("overwrite").partitionBy("index_name").parquet(f"{root}/metadata")
        meta = spark.read.parquet(f"{root}/metadata")
        # Sharded as the postings are: scores meet their documents without a shuffle.
        save_by_document(doc_meta(index.doc_stats, meta).repartition(index.shards, "doc_id"), f"{root}/doc_meta",
                         index.shards, ["doc_id"])
        result_records(meta).write.mode("overwrite").partitionBy("index_name") \
            .parquet(f"{root}/records")
    _mark_done(spark, root)
    release(spark)
    return load_store(spark, root)


def load_store(spark: SparkSession, root: str) -> Store:
    index = SearchIndex.load(spark, root)
    return Store(root, index, spark.read.parquet(f"{root}/metadata"),
                 load_by_document(spark, f"{root}/doc_meta", index.shards, ["doc_id"]), spark.read.parquet(f"{root}/records"))


def store_for(spark: SparkSession, sf_dir: str) -> Store:
    """The stored tables of ``sf_dir`` for this process, built on first use and
    again when the input files have changed."""
    key = (ensure_checkpoint_dir(spark), _input_state(spark, sf_dir))
    root = _ROOTS.get(key)
    if root is not None and _done(spark, root):
        return load_store(spark, root)
    store = build_store(spark, sf_dir)
    _ROOTS[key] = store.root
    return store
