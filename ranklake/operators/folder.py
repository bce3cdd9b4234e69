"""A folder of saved indexes: what is added to the folder answers at once.

Every index below the folder keeps its own bucketed postings, so each is scored
by itself (its score sum needs no exchange) and the scores are put together
afterwards. An index that no request names is not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.operators.postings import SearchIndex, index_registry
from ranklake.operators.query import clauses_from_q
from ranklake.operators.scoring import evaluate


def saved_indexes(spark: SparkSession, folder: str) -> list[str]:
    """Paths below ``folder`` that hold a whole saved index, by name. The
    term table is the last that ``SearchIndex.save`` writes."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/*/term_stats/_SUCCESS")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getParent().getParent().toString() for s in fs.globStatus(path) or [])


@dataclass
class IndexFolder:
    """The saved indexes of a folder and the index names that each holds."""

    indexes: list[SearchIndex]
    names: list[set[str]]

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> IndexFolder:
        """Raises where two saved indexes hold the same index name."""
        paths = saved_indexes(spark, folder)
        indexes = [SearchIndex.load(spark, p) for p in paths]
        names = [{r.index_name for r in index_registry(i).collect()} for i in indexes]  # an index name a row
        seen: dict[str, str] = {}
        for path, held in zip(paths, names, strict=True):
            for name in sorted(held):
                if name in seen:
                    raise ValueError(f"index {name} is held by {seen[name]} and {path}")
                seen[name] = path
        return cls(indexes, names)

    def registry(self, spark: SparkSession) -> DataFrame:
        """One row per known index name, for ``validate_requests``."""
        return spark.createDataFrame([(n,) for held in self.names for n in sorted(held)], "index_name string")

    def answer(self, requests: DataFrame, clauses_fn=clauses_from_q, **kw) -> DataFrame | None:
        """Scores of ``requests``, whose queries go through the analyser of the
        index that they name (indexes of one folder may differ in it)."""
        parts = []
        for analyser in sorted({i.analyser for i in self.indexes}):
            own = [k for k, i in enumerate(self.indexes) if i.analyser == analyser]
            some = IndexFolder([self.indexes[k] for k in own], [self.names[k] for k in own])
            parts.append(some.evaluate(clauses_fn(requests, analyser), **kw))
        parts = [p for p in parts if p is not None]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def evaluate(self, clauses: DataFrame, **kw) -> DataFrame | None:
        """Scores of ``clauses`` over all indexes of the folder (the arguments
        of ``scoring.evaluate``); None where no clause names a held index."""
        asked = {r.index_name for r in clauses.select("index_name").distinct()
                 .filter(F.col("index_name").isin(sorted(set().union(*self.names)))).collect()} if self.names else set()
        parts = [evaluate(clauses.filter(F.col("index_name").isin(sorted(held & asked))), index, **kw)
                 for index, held in zip(self.indexes, self.names, strict=True) if held & asked]
        return reduce(DataFrame.unionByName, parts) if parts else None
