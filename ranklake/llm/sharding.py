"""Sharding by a two-pass external shuffle, DataFrame functions only.

Pass 1 scatters records over buckets by a seeded hash; a bucket is sized to fit
in memory.  Pass 2 loads a bucket, puts it in a fixed order, applies Spark's
``shuffle`` (a seeded Fisher-Yates over the array) and writes it.  The buckets
laid end to end are one random order of the table, which is cut into shards
whose row counts differ by one at most.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ranklake.llm.common import materialize
from ranklake.session import scratch_path

BUCKET_BYTES = 8 << 20


def external_shuffle(records: DataFrame, row_bytes: Column, seed: int = 17,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` in one random order: all columns plus ``position`` (long,
    gapless from 0).

    ``row_bytes`` estimates what a record takes in memory; the number of
    buckets is total bytes / ``bucket_bytes``, so it grows with the table while
    a bucket does not.  The records are stored first; the hash is over a
    record's place in that store, so repeated rows spread like any others and a
    task that runs again after a lost executor draws the same buckets.

    Empty table: empty result.  Nulls are ordinary values.  Repeated rows each
    get a position.  Column names may be anything but ``position``: a record
    travels as one struct.
    """
    return materialize(_dealt(records, row_bytes, seed, bucket_bytes)[0], "shuffled")


def _dealt(records: DataFrame, row_bytes: Column, seed: int, bucket_bytes: int) -> tuple[DataFrame, int]:
    """What ``external_shuffle`` stores, to be evaluated once, and its rows."""
    whole = F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("rec")
    stored = materialize(records.select(whole, row_bytes.alias("b"), F.monotonically_increasing_id().alias("id")),
                         "records", compression="zstd")
    total, n = stored.agg(F.sum("b"), F.count("*")).first()
    buckets = max(1, math.ceil((total or 0) / bucket_bytes))
    dealt = stored.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(buckets)))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("bucket").agg(F.count("*").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    # as many tasks as buckets, so that a task holds few whatever the table's size
    held = dealt.repartition(buckets, "bucket").groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("id", "rec"))).alias("held"))
    # shuffle() draws in row order within a task, so that order is fixed too.
    mixed = held.sortWithinPartitions("bucket").select("bucket", F.shuffle("held", F.lit(seed)).alias("held"))
    flat = mixed.select("bucket", F.posexplode("held").alias("at", "x")).select("bucket", "at", "x.rec")
    return flat.join(F.broadcast(starts), "bucket").select("rec.*", (F.col("start") + F.col("at")).alias("position")), n


def cut_shards(shuffled: DataFrame, n_shards: int, n: int | None = None) -> DataFrame:
    """``shard`` (int) and ``slot`` (long) from ``position``: shards are
    consecutive runs of the order; the first (rows mod shards) hold one row
    more.  ``n`` is the number of rows, counted if not given."""
    n = shuffled.count() if n is None else n
    base, more = divmod(n, n_shards)
    wide = more * (base + 1)
    p = F.col("position")
    # base is 0 only if every row lies in the wide part
    shard = F.when(p < wide, F.floor(p / (base + 1))).otherwise(more + F.floor((p - wide) / max(1, base)))
    slot = F.when(p < wide, p % (base + 1)).otherwise((p - wide) % max(1, base))
    return shuffled.withColumns({"shard": shard.cast("int"), "slot": slot.cast("long")})


def write_shards(sharded: DataFrame, path: str, ranged: bool = True) -> None:
    """One folder per shard, its rows in slot order (``position`` is the order
    over all shards; a shard may be cut into several files).  ``ranged`` deals
    the rows so that a file is one stretch of the order; without it a file holds
    the buckets of a task."""
    if ranged:
        sharded = sharded.repartitionByRange(max(1, sharded.sparkSession.sparkContext.defaultParallelism), "shard", "slot")
    (sharded.sortWithinPartitions("shard", "slot")
     .write.option("compression", "zstd").partitionBy("shard").parquet(path))


def row_bytes(docs: DataFrame) -> Column:
    """About what a record takes in memory: its columns' bytes and 16 for each."""
    parts = [F.lit(16 * len(docs.columns)).cast("long")]
    for name, kind in docs.dtypes:
        if kind in ("string", "binary"):
            parts.append(F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)))
        elif "<" in kind:
            parts.append(F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0)))
    return reduce(add, parts)


def shard_whole(docs: DataFrame, path: str, n_shards: int = 16, seed: int = 17,
                bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The documents with all their columns, shuffled and written as shards to
    ``path``; what stands there: rec (a struct of the columns, whatever their
    names), position, slot, shard."""
    recs = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), row_bytes(docs).alias("b"))
    # straight from the buckets into the shards: the text is shuffled once
    order, n = _dealt(recs, F.col("b"), seed, bucket_bytes)
    out = cut_shards(order, n_shards, n).select("rec", "position", "slot", "shard")
    write_shards(out, path, ranged=False)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 17, path: str | None = None,
                    bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Writes the documents (doc_id, text and any other columns) as shards to
    ``path`` (a folder in the shared checkpoint folder if not given) and returns
    the digest of what was written: doc_id, size (UTF-8 bytes + 1; null text
    counts none), text_crc32, law 'rows', shard, slot, grown_shard (null under
    this law).  A null text has the checksum of the empty one."""
    out = shard_whole(docs, path or scratch_path(docs.sparkSession, "shards"), n_shards, seed, bucket_bytes)
    text = F.coalesce("rec.text", F.lit(""))
    return out.select("rec.doc_id", (F.octet_length(text).cast("long") + 1).alias("size"),
                      F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
