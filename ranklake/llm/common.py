"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ranklake.session import scratch_path

#: White space that separates words: space, tab to carriage return.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"


def materialize(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet (with the writer's ``options``) in the shared
    checkpoint folder and read back: computed once, lineage cut, readable after
    an executor is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parallel(df: DataFrame) -> DataFrame:
    """``df`` dealt evenly over the cores when it comes from fewer partitions
    than there are cores (one small file); a large table is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def content_key(*cols: Column | str) -> Column:
    """128-bit identity of the values: two xxHash64 with different seeds.
    Among 10^12 values a collision has a chance below 10^-14."""
    return F.struct(F.xxhash64(*cols).alias("a"),
                    F.xxhash64(F.lit(0x5EED), *cols).alias("b"))


def cumulative(rows: DataFrame, group: list[str], order: list[str], weight: Column,
               out: str, chunk_rows: int = 10_000) -> DataFrame:
    """Running sum of ``weight`` over the rows of a group, before each row, as
    column ``out`` (0 for the first row).

    A group may hold most of the table, so it is not one window: rows are dealt
    by a hash of ``order`` into chunks of about ``chunk_rows``; a chunk is
    sorted by ``order`` in its own window and starts at the total of the
    group's earlier chunks.  The order of a group is therefore (chunk,
    ``order``): fixed by the data, alike on every run.  ``rows`` is read three
    times, so it should be a stored table.
    """
    n = rows.count()
    chunks = max(1, math.ceil(n / chunk_rows))
    df = rows.withColumns({"_w": weight, "_chunk": F.pmod(F.xxhash64(*order), F.lit(chunks))})
    key = [*group, "_chunk"]
    totals = df.groupBy(*key).agg(F.sum("_w").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*key, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    own = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_own", F.coalesce(F.sum("_w").over(own), F.lit(0)))
    df = df.join(starts, key, "left")
    return df.withColumn(out, F.col("_start") + F.col("_own")).drop("_w", "_chunk", "_own", "_start")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, component) for every vertex that an edge (a, b) touches; component is
    the smallest vertex reachable.

    Alternating stars: in the large step every neighbour above a vertex is
    linked to the vertex's smallest neighbour, in the small step every
    neighbour below; a component shrinks to a star in about log(diameter)
    rounds.  Minima are plain aggregations (combined before the shuffle), so a
    hub's neighbours are never gathered; joins on a hub are split by the
    adaptive skew join.  Each round is a stored table.
    """
    links = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = materialize(links.distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
        large = large.where("hi <> lo").distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi")
        small = small.select(F.col("hi"), F.col("m").alias("lo")).union(
            small.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")))
        links = materialize(small.distinct(), "links")
        now = links.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    star = links.groupBy("hi").agg(F.min("lo").alias("component")).withColumnRenamed("hi", "v")
    return star.union(links.select(F.col("lo").alias("v"), F.col("lo").alias("component")).distinct())
