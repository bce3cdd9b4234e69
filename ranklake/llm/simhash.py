"""SimHash near-duplicates by pivot distance tables.

Every fingerprint gets a row of Hamming distances to fixed reference
fingerprints: a base, and the base with one short block of bits flipped, for
every block.  The distance to a block's reference less the distance to the base
depends on that block alone, and two fingerprints at most ``bits`` apart can
differ in at most ``bits`` blocks.  So the table's columns are dealt into groups
and a pair worth looking at agrees in all columns of all but ``bits`` groups:
candidates come from equal rows of such column sets, not from all pairs.  A
candidate is discarded if any two coordinates differ by more than ``bits``
(the triangle inequality); survivors are verified on the fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ranklake.llm.common import connected_components, content_key, materialize, parallel

#: Bits in a block; blocks are dealt into ``bits + EXTRA_GROUPS`` groups.
BLOCK = 2
EXTRA_GROUPS = 4
BASE = 0x5555555555555555


def text_fingerprint(text: str | None, words: int) -> int:
    """64-bit SimHash of a text's shingles of ``words`` words (A-Z
    lower-cased, repeats included; fewer words: the whole sequence; none or
    null: 0), as a signed integer."""
    toks = text.encode().lower().split() if text else []
    if not toks:
        return 0
    joined = b" ".join(toks)
    ends = np.cumsum([len(t) + 1 for t in toks]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(toks) - words + 1)
    last = ends[min(words, len(toks)) - 1:].tolist()
    digest = xxhash.xxh64_digest
    # digests are big-endian: unpacked, column 0 is the highest bit
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last, strict=True)])
    ones = np.zeros(64, np.int64)
    flat = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(flat[at:at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">i8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, ka, kb, fp long) of every row; ka, kb identify the text."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.fromiter((text_fingerprint(t, words) for t in b.pop("text")), np.int64, len(b))
            yield b.assign(fp=fp)
    key = content_key("text")
    slim = docs.select(F.col("doc_id").cast("long"), key["a"].alias("ka"), key["b"].alias("kb"), "text")
    return parallel(slim).mapInPandas(run, "doc_id long, ka long, kb long, fp long")


def references() -> list[int]:
    """The base and the base with one block flipped, block after block, as
    signed integers."""
    refs = [BASE] + [BASE ^ (((1 << BLOCK) - 1) << at) for at in range(0, 64, BLOCK)]
    return [r - (1 << 64) if r >> 63 else r for r in refs]


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fps`` (fp) with ``dist``, the Hamming distances to the references, and
    ``relative``, the same distances less the base's, two bits for each block:
    (distance - base distance + BLOCK) / 2 is 0 to BLOCK."""
    dist = F.array(*[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("byte") for r in references()])
    return fps.withColumn("dist", dist).withColumn("relative", F.expr(
        f"aggregate(transform(slice(dist, 2, {64 // BLOCK}), (d, i) -> shiftleft("
        f"cast(shiftright(d - dist[0] + {BLOCK}, 1) as bigint), 2 * i)), 0L, (x, y) -> x | y)"))


def _masks(bits: int) -> list[int]:
    """Bits of ``relative`` that belong to all groups of blocks but ``bits``,
    for every choice of those; signed integers."""
    groups, blocks = bits + EXTRA_GROUPS, 64 // BLOCK
    if bits < 0 or groups > blocks:
        raise ValueError("too many bits for the number of blocks")
    of = [sum(3 << 2 * b for b in range(blocks) if b % groups == g) for g in range(groups)]
    masks = [sum(of[g] for g in keep) for keep in combinations(range(groups), groups - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near_pairs(fps: DataFrame, bits: int = 2) -> DataFrame:
    """Verified links (a, b), a < b, between distinct fingerprints (fp)."""
    table = materialize(pivot_table(fps), "pivots")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("s"), F.col("relative").bitwiseAND(F.lit(m)).alias("key"))
                               for i, m in enumerate(_masks(bits))]))
    rows = table.select("fp", "dist", keys.alias("k")).select("fp", "dist", "k.s", "k.key")
    left = rows.select("s", "key", F.col("fp").alias("a"), F.col("dist").alias("da"))
    right = rows.select("s", "key", F.col("fp").alias("b"), F.col("dist").alias("db"))
    gap = F.array_max(F.zip_with("da", "db", lambda x, y: F.abs(x.cast("int") - y.cast("int"))))
    found = left.join(right, ["s", "key"]).where("a < b").where(gap <= bits)
    found = found.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
    return found.select("a", "b").distinct()


def components(fps: DataFrame, bits: int = 2) -> DataFrame:
    """(fp, component, component_id) for the distinct fingerprints of stored
    ``fps`` (doc_id, fp): component is the smallest fingerprint that links
    reach, component_id the smallest doc_id."""
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = connected_components(near_pairs(classes.select("fp"), bits))
    of = classes.join(links, classes.fp == links.v, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("least").alias("component_id"))
    return of.join(least, "component").select("fp", "component", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Equal fingerprints are one class (zero included: empty, blank and null
    texts are linked with each other); pairs are looked for between classes.
    component_id is the smallest doc_id that links reach, null only if all of
    the component's are.  Repeated rows give repeated rows; an empty table an
    empty one; further columns are ignored.
    """
    stored = materialize(fingerprints(docs, words), "fingerprints")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return stored.join(components(stored, bits), "fp").select("doc_id", hexed, "component_id")


def keep_one(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """``docs`` (any columns with doc_id, text) with one row of every
    component: the smallest doc_id's (of rows that share it the smallest
    text's hash, of fully repeated rows one)."""
    stored = materialize(fingerprints(docs, words), "fingerprints")
    of = stored.join(components(stored, bits), "fp")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "ka", "kb")).alias("first")
    stay = of.groupBy("component").agg(first).select(
        F.col("first.doc_id").alias("_d"), F.col("first.ka").alias("_a"), F.col("first.kb").alias("_b"))
    key = content_key("text")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_i"), key["a"].alias("_x"), key["b"].alias("_y"))
    rows = rows.join(stay, F.col("_i").eqNullSafe(F.col("_d")) & (F.col("_x") == F.col("_a")) & (F.col("_y") == F.col("_b")))
    copy = F.row_number().over(Window.partitionBy("_i", "_x", "_y").orderBy(F.lit(0)))
    return rows.withColumn("_n", copy).where("_n = 1").select("rec.*")
