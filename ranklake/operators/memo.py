"""A stored memo of text vectors: a text is embedded once, in any later run too."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.session import scratch_path, ship_package

#: Texts given to the model at a time.
BATCH_TEXTS = 64
#: Texts of one task: what a lost executor has to embed again is bounded.
TASK_TEXTS = 4096

MEMO = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("vec", T.ArrayType(T.FloatType()))])
TRIED = T.StructType([*MEMO.fields, T.StructField("error", T.StringType())])

#: A model: texts in, one vector for each, in order.
Model = Callable[[list[str]], list[list[float]]]


def _key(col: str):
    """A text's key: the SHA-256 of its UTF-8 bytes."""
    return F.unhex(F.sha2(F.col(col).cast("binary"), 256))


def _call(model: Model, size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at:at + size]
                try:
                    vecs = [[float(x) for x in v] for v in model(list(part["text"]))]
                    if len(vecs) != len(part):
                        raise ValueError(f"{len(vecs)} vectors for {len(part)} texts")
                    yield pd.DataFrame({"key": part["key"], "vec": vecs, "error": None})
                except Exception as e:  # the model's own failures, of any kind: this batch only
                    yield pd.DataFrame({"key": part["key"], "vec": None, "error": f"{type(e).__name__}: {e}"})
    return run


class EmbeddingMemo:
    """Vectors by text below ``path`` (Parquet, one folder a run, so that a run
    is there wholly or not at all). One writer at a time.

    ``embed`` gives the model the distinct texts without a stored vector, in
    batches; a batch that fails is reported in ``error`` and tried again by the
    next run, the others are kept. A null text has no vector and is never sent;
    the empty text is a text. Rows keep their columns and their number."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _runs(self) -> list[str]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/run-*/_SUCCESS")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return sorted(s.getPath().getParent().toString() for s in fs.globStatus(path) or [])

    def stored(self) -> DataFrame:
        """(key, vec) of all runs, one row a key."""
        runs = self._runs()
        if not runs:
            return self.spark.createDataFrame([], MEMO)
        return self.spark.read.schema(MEMO).parquet(*runs).dropDuplicates(["key"])

    def embed(self, texts: DataFrame, model: Model, text_col: str = "text", batch_texts: int = BATCH_TEXTS,
              task_texts: int = TASK_TEXTS) -> DataFrame:
        """``texts`` with ``vec`` and ``error`` (null where there is a vector)."""
        ship_package(self.spark)
        distinct = (texts.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull()).distinct()
                    .withColumn("key", _key("text")))
        new = distinct.join(self.stored().select("key"), "key", "left_anti")
        # Written before the model sees it: the number of texts says how many
        # tasks there are, and a task that runs again sees the same texts.
        waiting = scratch_path(self.spark, "memo-new")
        new.write.parquet(waiting)
        new = self.spark.read.parquet(waiting)
        n = new.count()
        tried = None
        if n:
            out = scratch_path(self.spark, "memo-tried")
            (new.repartition(-(-n // task_texts), "key").mapInPandas(_call(model, batch_texts), TRIED)
             .write.parquet(out))
            tried = self.spark.read.parquet(out)
            (tried.filter(F.col("error").isNull()).select("key", "vec")
             .write.parquet(scratch_run(self.path)))
        rows = texts.withColumn("_key", _key(text_col))
        rows = rows.join(self.stored().withColumnRenamed("key", "_key"), "_key", "left")
        if tried is None:
            return rows.drop("_key").withColumn("error", F.lit(None).cast("string"))
        failed = tried.filter(F.col("error").isNotNull()).select(F.col("key").alias("_key"), "error")
        return rows.join(failed, "_key", "left").drop("_key")


def scratch_run(path: str) -> str:
    """A fresh run folder of a memo."""
    import uuid
    return f"{path}/run-{uuid.uuid4().hex}"
