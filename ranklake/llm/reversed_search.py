"""Ranked lexical search the other way round: the items wait, the documents pass.

The items' terms form an inverted index (term -> items with the term's count in
the item) that is broadcast; every document's term counts are streamed through
it once, and each item keeps a bounded heap of its best documents per task.
The tasks' heaps are merged at the end, so a task ships at most k rows an item
however many documents it has read.

The index is broadcast behind a size bound: items are dealt into blocks of at
most ``block_bytes`` of text, and a block is one pass.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import materialize, parallel

# Fixed values of the contract: ASCII characters that separate terms (all but
# digits and letters), and the weights of the score.
SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
BASE, SLOPE = 100, 25

#: UTF-8 bytes: separators become blanks, A-Z lower case, all others stay.
FOLD = bytes(32 if c in SEPARATORS else c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Bytes of item text whose index one pass broadcasts.
BLOCK_BYTES = 4 << 20
#: Cells of a task's score table (documents x items of a block).
CELLS = 1 << 21
#: Documents read at a time.
ROWS = 1024
#: Partial merges of an item's heaps before the last one.
MERGES = 32

COUNTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType())),
])
BEST = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a UTF-8 text, in its order."""
    return text.translate(FOLD).split() if text else []


@dataclass
class ItemIndex:
    """Inverted index over one block of items."""

    items: np.ndarray          # the block's item numbers
    terms: dict[bytes, int]    # term -> its number
    holders: list[np.ndarray]  # term number -> places in ``items``
    counts: list[np.ndarray]   # term number -> the term's count in each holder

    @classmethod
    def build(cls, rows: list[tuple[int, bytes | None]]) -> "ItemIndex":
        terms: dict[bytes, int] = {}
        held: list[list[tuple[int, int]]] = []
        for place, (_, text) in enumerate(rows):
            for term, n in Counter(terms_of(text)).items():
                number = terms.setdefault(term, len(terms))
                if number == len(held):
                    held.append([])
                held[number].append((place, n))
        return cls(np.array([r for r, _ in rows], np.int64), terms,
                   [np.array([p for p, _ in h], np.int64) for h in held],
                   [np.array([n for _, n in h], np.int64) for h in held])


def item_blocks(items: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Items (numbered) dealt into blocks of at most ``block_bytes`` of text (a
    single larger item is a block's only one), and the number of blocks."""
    size = F.coalesce(F.octet_length("_text"), F.lit(0)) + 16
    total = items.agg(F.sum(size)).first()[0] or 0
    n = max(1, math.ceil(2 * total / block_bytes)) if total > block_bytes else 1
    while True:
        dealt = items.withColumn("_block", F.pmod(F.xxhash64("_item", F.lit(n)), F.lit(n)))
        each = dealt.groupBy("_block").agg(F.sum(size).alias("bytes"), F.count("*").alias("items"))
        if n == 1 and total <= block_bytes or each.where((F.col("bytes") > block_bytes) & (F.col("items") > 1)).isEmpty():
            return dealt, n
        n *= 2


def term_counts(docs: DataFrame, index) -> DataFrame:
    """doc_id, n (terms with repeats) and the counts of the index's terms, of
    every row of docs (doc_id, text) that has a term."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.value.terms
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids, n, terms, tfs, ends = [], [], [], [], [0]
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    found = terms_of(text)
                    if not found:
                        continue
                    ids.append(d)
                    n.append(len(found))
                    tf = Counter(found)
                    for term in tf.keys() & number.keys():
                        terms.append(number[term])
                        tfs.append(tf[term])
                    ends.append(len(terms))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(n, pa.int64()),
                     pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                     pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], names=COUNTS.names)

    slim = docs.select(F.col("doc_id").cast("long"), F.encode("text", "UTF-8").alias("text"))
    return parallel(slim).mapInArrow(count, COUNTS)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class Heaps:
    """The best ``k`` documents of every item; equal scores: smaller doc_id
    (null last)."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.heaps: list[list[tuple]] = [[] for _ in range(items)]
        self.floor = np.ones(items, np.int64)  # least score that may still enter

    def take(self, doc_ids: list, scores: np.ndarray) -> None:
        """Scores of some documents (rows) for all items (columns)."""
        floor = self.floor
        if len(doc_ids) > self.k:  # what k others of these rows surpass need not be tried
            floor = np.maximum(floor, np.partition(scores, len(doc_ids) - self.k, axis=0)[len(doc_ids) - self.k])
        rows, items = np.nonzero(scores >= floor)
        for row, item, score in zip(rows.tolist(), items.tolist(), scores[rows, items].tolist(), strict=True):
            d, heap = doc_ids[row], self.heaps[item]
            entry = (score, d is not None, -(d or 0))
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            else:
                heapq.heappushpop(heap, entry)
        for item in set(items.tolist()):
            if len(self.heaps[item]) == self.k:
                self.floor[item] = max(1, self.heaps[item][0][0])


def best_of_tasks(counts: DataFrame, index, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of every item in each task."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, weight = index.value, weights.value
        heaps = Heaps(len(ix.items), k)
        rows = max(1, min(ROWS, CELLS // max(1, len(ix.items))))
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                part = batch.slice(first, rows)
                doc_ids = part.column(0).to_pylist()
                n = part.column(1).to_numpy(zero_copy_only=False)
                held = part.column(2)
                terms = held.flatten().to_numpy(zero_copy_only=False)
                tf = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(doc_ids)), held.value_lengths().to_numpy(zero_copy_only=False))
                m = BASE - SLOPE + SLOPE * n * n_docs // n_terms
                gain = weight[terms] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
                scores = np.zeros((len(doc_ids), len(ix.items)), np.int64)
                order = np.argsort(terms, kind="stable")
                cuts = np.flatnonzero(np.diff(terms[order])) + 1
                for same in np.split(order, cuts) if len(order) else ():
                    t = terms[same[0]]  # a document holds a term once, an item too
                    scores[row[same][:, None], ix.holders[t]] += gain[same][:, None] * ix.counts[t]
                heaps.take(doc_ids, scores)
        out = [(item, -d if known else None, score) for item, heap in zip(ix.items.tolist(), heaps.heaps, strict=True)
               for score, known, d in heap]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=BEST.names)

    return counts.mapInArrow(stream, BEST)


def merged(best: DataFrame, k: int) -> DataFrame:
    """The tasks' heaps merged: first in ``MERGES`` parts an item, then whole."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    part = Window.partitionBy("item", F.pmod(F.xxhash64("doc_id"), F.lit(MERGES))).orderBy(*order)
    best = best.withColumn("_r", F.row_number().over(part)).where(F.col("_r") <= k).drop("_r")
    whole = Window.partitionBy("item").orderBy(*order)
    return best.withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, text (the item's), rank, doc_id and score: the ``k`` best
    documents (doc_id, text) of every row of items (item_id, text).

    Every row is a document or an item by itself, so repeated rows rank next to
    each other and repeated items each get their rows.  A null or empty text, or
    one without a term, counts in no statistic and matches nothing; an item
    without a hit has no row; a null doc_id stands after all others of its
    score.  Further columns are ignored.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    numbered = materialize(items.select("item_id", F.col("text").alias("_text"), F.monotonically_increasing_id().alias("_item")), "items")
    dealt, blocks = item_blocks(numbered, block_bytes)
    hits = None
    for block in range(blocks):
        # one block: at most block_bytes of text, or a single item
        rows = dealt.where(F.col("_block") == block).select("_item", F.encode("_text", "UTF-8").alias("t")).collect()
        if not rows and blocks > 1:
            continue
        index = spark.sparkContext.broadcast(ItemIndex.build([(r._item, r.t and bytes(r.t)) for r in rows]))
        counts = materialize(term_counts(docs, index), "term-counts")
        n_docs, n_terms = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = np.zeros(max(1, len(index.value.terms)), np.int64)
        # a row per term of the block at most
        for r in counts.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            weight[r.t] = term_weight(n_docs, r.df)
        best = best_of_tasks(counts, index, spark.sparkContext.broadcast(weight), n_docs, n_terms, k)
        found = merged(best, k)
        hits = found if hits is None else hits.unionByName(found)
    return numbered.join(hits, F.col("_item") == F.col("item")).select(
        "item_id", F.col("_text").alias("text"), "rank", "doc_id", "score")


def ranking(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score."""
    return search(docs, items, k).select("item_id", "rank", "doc_id", "score")
