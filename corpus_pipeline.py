"""The corpus pipeline: documents through toxicity, line dedup, near-dedup,
mixing and packing.  Every stage's result is stored and read again as the next
one's input, so a lost executor costs no more than the running stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ranklake.llm import line_dedup, mixing, packing, simhash, toxicity
from ranklake.session import ensure_checkpoint_dir, scratch_path, ship_package
from ranklake.sources.tables import read_table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on their labels, does not reject."""
    ship_package(spark)
    return toxicity.keep_clean(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents share; none goes."""
    ship_package(spark)
    return line_dedup.without_frequent_lines(docs, min_docs=10, min_chars=1)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of linked fingerprints: the smallest doc_id."""
    ship_package(spark)
    return simhash.keep_one(docs, words=3, bits=2)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document's rows are the stretches of it that
    the mix takes, repeats included."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two length, with their ids."""
    ship_package(spark)
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", clean), ("line dedup", lines), ("simhash near-dedup", near), ("mixing", mixed), ("packing", packed)]

#: Training, hashing and tokenising have no SQL form; tests hold the stages
#: against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    ensure_checkpoint_dir(spark)
    docs = read_table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = scratch_path(spark, f"stage-{n}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
