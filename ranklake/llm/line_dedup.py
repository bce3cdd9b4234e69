"""Reversible line dedup: exact reference counts per line, sharded cuckoo
filters of the frequent ones.

The counts table holds, for every line key, the number of documents it is in;
inserting documents adds to it and deleting documents takes away, so a deletion
restores exactly what was before.  The filters hold the keys at or above the
threshold: a key enters when its count reaches it and is deleted from its
filter when the count falls below.  A line that misses its filter stays without
a look at the counts; a hit is checked against the exact count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm.common import content_key, materialize, parallel

STRIP = b" \t\n\x0b\x0c\r"
SLOTS = 4
MAX_KICKS = 200
#: Filters up to this size go to every task; beyond it lines are joined with
#: the exact counts without a filter.
FILTER_BYTES = 64 << 20
#: Frequent keys that a filter shard holds about; with more keys the shards are
#: doubled and their filters built anew.
SHARD_KEYS = 1 << 18


class CuckooFilter:
    """16-bit fingerprints in buckets of four; a key's two buckets differ by a
    hash of its fingerprint, so a fingerprint can move or go without its key."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        """Empty, with room for ``keys`` at a load of at most 0.8."""
        buckets = 1
        while buckets * SLOTS * 0.8 < keys:
            buckets *= 2
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of_bytes(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def places(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of keys given by their second hash."""
        u = b.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        mark = (u & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (u >> np.uint64(20)) & mask
        return mark, one, one ^ self.step(mark)

    def step(self, mark: np.ndarray) -> np.ndarray:
        h = mark.astype(np.uint64) * np.uint64(0x9E3779B1)
        return (h ^ (h >> np.uint64(15))) & np.uint64(len(self.table) - 1)

    def contains(self, b: np.ndarray) -> np.ndarray:
        mark, one, two = self.places(b)
        return ((self.table[one] == mark[:, None]) | (self.table[two] == mark[:, None])).any(axis=1)

    def insert(self, b: np.ndarray) -> bool:
        """False if a key found no place: the table must be built anew, larger."""
        steps = self.step(np.arange(1 << 16, dtype=np.uint16))
        turn = 0
        for mark, one, two in zip(*(x.tolist() for x in self.places(b)), strict=True):
            at = one
            for bucket in (one, two):
                free = np.flatnonzero(self.table[bucket] == 0)
                if len(free):
                    self.table[bucket, free[0]] = mark
                    break
            else:
                for _ in range(MAX_KICKS):
                    turn = (turn * 5 + 1) % 1024
                    slot = turn % SLOTS
                    mark, self.table[at, slot] = int(self.table[at, slot]), mark
                    at ^= int(steps[mark])
                    free = np.flatnonzero(self.table[at] == 0)
                    if len(free):
                        self.table[at, free[0]] = mark
                        break
                else:
                    return False
        return True

    def delete(self, b: np.ndarray) -> None:
        for mark, one, two in zip(*(x.tolist() for x in self.places(b)), strict=True):
            for bucket in (one, two):
                held = np.flatnonzero(self.table[bucket] == mark)
                if len(held):
                    self.table[bucket, held[0]] = 0
                    break


def build_filter(b: np.ndarray) -> CuckooFilter:
    room = len(b)
    while True:
        made = CuckooFilter.sized(room)
        if made.insert(b):
            return made
        room = 2 * room + SLOTS


def _keys(text: str | None, min_chars: int) -> list[tuple[int, bytes] | None]:
    """Of every line the 16-byte hash of its key; None for a key that is too
    short.  A null text is one empty line."""
    out: list = []
    for line in (text or "").encode().lower().split(b"\n"):
        key = line.strip(STRIP)
        short = not key if min_chars <= 1 else len(key.decode()) < min_chars
        out.append(None if short else xxhash.xxh3_128_digest(key))
    return out


def _halves(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def line_counts(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(a, b, n): line keys as 128-bit hashes and the documents (rows) each is
    found in; a key counts once in a document."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: list[bytes] = []
            for text in batch["text"]:
                found.extend({k for k in _keys(text, min_chars) if k})
            a, b = _halves(found)
            yield pd.DataFrame({"a": a, "b": b})
    pairs = parallel(docs.select("text")).mapInPandas(run, "a long, b long")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


@dataclass(frozen=True)
class LineIndex:
    """State of the dedup: ``counts`` (shard, a, b, n, was) and ``filters``
    (shard, data).  Every change gives a new state in stored tables."""

    spark: SparkSession
    counts: DataFrame
    filters: DataFrame
    min_docs: int = 10
    min_chars: int = 1
    shards: int = 64

    @classmethod
    def empty(cls, spark: SparkSession, min_docs: int = 10, min_chars: int = 1, shards: int = 64) -> LineIndex:
        return cls(spark, spark.createDataFrame([], "shard int, a long, b long, n long, was long"),
                   spark.createDataFrame([], "shard int, data binary"), min_docs, min_chars, shards)

    @classmethod
    def load(cls, spark: SparkSession, path: str, **limits) -> LineIndex:
        """The state saved at ``path``, with its number of shards."""
        shards = spark.read.parquet(f"{path}/layout").first().shards
        return cls(spark, spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/filters"), **{**limits, "shards": shards})

    def save(self, path: str) -> None:
        self.counts.write.parquet(f"{path}/counts")
        self.filters.write.parquet(f"{path}/filters")
        self.spark.createDataFrame([(self.shards,)], "shards int").write.parquet(f"{path}/layout")

    def insert(self, docs: DataFrame) -> LineIndex:
        return self._change(line_counts(docs, self.min_chars))

    def delete(self, docs: DataFrame) -> LineIndex:
        """Undoes the insertion of ``docs``.  Lines that were never inserted
        are passed over: no count falls below zero."""
        return self._change(line_counts(docs, self.min_chars).withColumn("n", -F.col("n")))

    def _change(self, delta: DataFrame) -> LineIndex:
        old = self.counts.select("a", "b", "n", F.col("n").alias("was"))
        both = old.unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        new = both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("was").alias("was"))
        new = new.where("n > 0 or was > 0").select("a", "b", F.greatest("n", F.lit(0)).alias("n"), "was")
        counts = materialize(new, "line-counts")
        up, down = F.col("n") >= self.min_docs, F.col("was") >= self.min_docs
        hot, shards = counts.where(up).count(), self.shards
        while hot > shards * SHARD_KEYS:
            shards *= 2
        counts = counts.select(F.pmod("a", F.lit(shards)).cast("int").alias("shard"), "a", "b", "n", "was")
        if shards == self.shards:
            moved = counts.where(up != down).select("shard", "b", up.alias("enters"))
            filters = materialize(self._refilter(moved), "line-filters")
        else:  # every filter anew
            filters = self.spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(None).cast("binary").alias("data"))
        full = filters.where("data is null").select("shard")
        if not full.isEmpty():
            hot = counts.where(up).join(full, "shard", "left_semi").select("shard", "b")
            rebuilt = hot.groupBy("shard").applyInPandas(
                lambda p: pd.DataFrame({"shard": p["shard"].iloc[:1], "data": [build_filter(np.sort(p["b"].to_numpy())).table.tobytes()]}),
                "shard int, data binary")
            filters = materialize(filters.where("data is not null").unionByName(rebuilt), "line-filters")
        return LineIndex(self.spark, counts.where("n > 0"), filters, self.min_docs, self.min_chars, shards)

    def _refilter(self, moved: DataFrame) -> DataFrame:
        """Filters after keys entered and left; data is null where a shard must
        be built anew from the counts (new shard, or no room)."""
        def run(held: pd.DataFrame, moved: pd.DataFrame) -> pd.DataFrame:
            shard = (held if len(held) else moved)["shard"].iloc[:1].astype("int32").reset_index(drop=True)
            data = None
            if len(held):
                now = CuckooFilter.of_bytes(held["data"].iloc[0])
                now.delete(moved.loc[~moved["enters"], "b"].to_numpy())
                if now.insert(np.sort(moved.loc[moved["enters"], "b"].to_numpy())):
                    data = now.table.tobytes()
            return pd.DataFrame({"shard": shard, "data": [data]})
        return self.filters.groupBy("shard").cogroup(moved.groupBy("shard")).applyInPandas(run, "shard int, data binary")

    def frequent_lines(self, texts: DataFrame) -> DataFrame:
        """(key, lines): of texts (key, text) those with frequent lines, and
        the numbers of these lines, ascending."""
        size = self.filters.agg(F.sum(F.length("data"))).first()[0] or 0
        held = None
        if size <= FILTER_BYTES:
            held = self.spark.sparkContext.broadcast({r.shard: bytes(r.data) for r in self.filters.collect()})
        shards, min_chars = self.shards, self.min_chars

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            filters = None if held is None else {s: CuckooFilter.of_bytes(d) for s, d in held.value.items()}
            for batch in batches:
                at, line, found = [], [], []
                for i, text in enumerate(batch["text"]):
                    for j, k in enumerate(_keys(text, min_chars)):
                        if k:
                            at.append(i)
                            line.append(j)
                            found.append(k)
                a, b = _halves(found)
                out = pd.DataFrame({"row": np.array(at, int), "line": np.array(line, "i4"), "a": a, "b": b})
                if filters is not None:
                    shard = a % shards
                    hit = np.zeros(len(a), bool)
                    for s in np.unique(shard):
                        if s in filters:
                            own = np.flatnonzero(shard == s)
                            hit[own] = filters[s].contains(b[own])
                    out = out[hit]
                rows = out.pop("row").to_numpy()
                out.insert(0, "ka", batch["ka"].to_numpy()[rows])
                out.insert(1, "kb", batch["kb"].to_numpy()[rows])
                yield out
        slim = texts.select("key.a", "key.b", "text").toDF("ka", "kb", "text")
        hits = slim.mapInPandas(run, "ka long, kb long, line int, a long, b long")
        hot = self.counts.where(F.col("n") >= self.min_docs).select("a", "b")
        sure = hits.join(hot, ["a", "b"], "left_semi")
        return sure.groupBy("ka", "kb").agg(F.array_sort(F.collect_set("line")).alias("lines")).select(
            F.struct(F.col("ka").alias("a"), F.col("kb").alias("b")).alias("key"), "lines")

    def clean(self, docs: DataFrame) -> DataFrame:
        """``docs`` (any columns with ``text``) with the lines that are
        frequent in this state removed, plus n_lines and n_dropped (long).

        A null text is one empty line and stays null; a text all of whose
        lines go is empty.  Repeated rows are treated alike.  The numbers of
        lines to drop are found once per distinct text; no other column is
        looked at, except that ``n_lines``, ``n_dropped`` are overwritten.
        """
        keyed = parallel(docs.drop("n_lines", "n_dropped")).withColumn("_key", content_key("text"))
        texts = keyed.select(F.col("_key").alias("key"), "text")
        drop = self.frequent_lines(texts).select(F.col("key.a").alias("_a"), F.col("key.b").alias("_b"), F.col("lines").alias("_lines"))
        # Stored, so that the join reads both sides as they are and the rows of
        # one text's many copies can be split over tasks.
        drop = materialize(drop, "line-numbers")
        both = keyed.join(drop, (F.col("_key.a") == F.col("_a")) & (F.col("_key.b") == F.col("_b")), "left")

        @F.pandas_udf("string")
        def without(text: pd.Series, lines: pd.Series) -> pd.Series:
            out = []
            for t, gone in zip(text, lines, strict=True):
                gone = None if t is None else set(gone.tolist())
                out.append(None if t is None else "\n".join([x for i, x in enumerate(t.split("\n")) if i not in gone]))
            return pd.Series(out, dtype=object)
        n = F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
        loses = F.col("_lines").isNotNull()
        # only the texts that lose lines leave the JVM
        kept = without(F.when(loses, F.col("text")), F.col("_lines"))
        return both.withColumns({"n_lines": F.coalesce(n, F.lit(1)).cast("long"),
                                 "n_dropped": F.when(loses, F.size("_lines")).otherwise(0).cast("long"),
                                 "text": F.coalesce(kept, "text")}).drop("_key", "_a", "_b", "_lines")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One-shot dedup: every document is inserted, then cleaned."""
    index = LineIndex.empty(docs.sparkSession, min_docs, min_chars).insert(docs)
    return index.clean(docs)


def without_frequent_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with its own columns: ``text`` without frequent lines and
    ``n_chars``, if there, counted anew where lines went.  No row goes."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
    out = dedup_lines(docs.select(whole, "text"), min_docs, min_chars)
    types = dict(docs.dtypes)
    new = {"text": F.col("text")}
    if "n_chars" in types:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(types["n_chars"])).otherwise(F.col("rec.n_chars"))
    return out.select(*[new.get(c, F.col("rec").getField(c)).alias(c) for c in docs.columns])


def digest(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row of docs (doc_id,
    text); a null text has the checksum of the empty one."""
    out = dedup_lines(docs.select("doc_id", "text"), min_docs, min_chars)
    kept = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))
