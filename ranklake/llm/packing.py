"""Packing by power-of-two decomposition.

A document of L tokens is cut into pieces whose lengths are the binary digits
of L (after as many full pieces as fit); pieces of equal length form a bucket.
A piece is a sequence by itself, so no sequence crosses documents and none
needs padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import cumulative, materialize, parallel

#: Documents encoded at a time.
ROWS = 500
MAX_LENGTH = 2048
END_ID = 1

PIECES = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("start", T.LongType()),
    T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()),
])
IDS = T.StructField("ids", T.ArrayType(T.IntegerType()))


@cache
def encoder(vocabulary: str):
    """Byte-level BPE of a public vocabulary, given by the name of its
    ``tokenizers`` file; an added token that stands in a text (such as the mark
    of a text's end) is its one id.  The same vocabulary's rank file is read
    where the package has one: it yields the same ids four times as fast (a
    test holds the two against each other)."""
    import json
    import os

    import public_tokenizers

    ranks = public_tokenizers.path(vocabulary.replace(".json", ".tiktoken"))
    with open(public_tokenizers.path(vocabulary), encoding="utf-8") as f:
        added = json.load(f).get("added_tokens") or []
    plain = not any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if os.path.exists(ranks) and plain:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        special = {t["content"]: t["id"] for t in added}
        bpe = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens=special,
                                mergeable_ranks={k: v for k, v in table.items() if v not in special.values()})

        def ids(text: str) -> np.ndarray:
            held = any(t in text for t in special)  # the search for added tokens is slow, and mostly idle
            return np.array(bpe.encode(text, allowed_special="all") if held else bpe.encode_ordinary(text), dtype="<u4")

        return ids
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path(vocabulary))
    return lambda text: np.array(tok.encode(text, add_special_tokens=False).ids, dtype="<u4")


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as full pieces of ``longest`` (a power of two) and then its
    remaining binary digits, largest first."""
    full, rest = divmod(n, longest)
    return [longest] * full + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if rest >> b & 1]


def pieces_of(docs: pa.RecordBatch, encode, longest: int, with_ids: bool) -> pa.RecordBatch:
    """The pieces of a few documents (doc_id, text)."""
    doc, start, size, crc, tokens, held = [], [], [], [], [], []
    for d, text in zip(docs.column(0).to_pylist(), docs.column(1).to_pylist(), strict=True):
        ids = np.append(encode(text) if text else np.empty(0, "<u4"), np.uint32(END_ID))
        at = 0
        for n in binary_lengths(len(ids), longest):
            crc.append(zlib.crc32(ids[at:at + n].tobytes()))
            start.append(at)
            size.append(n)
            doc.append(d)
            tokens.append(len(ids))
            at += n
        held.append(ids)
    columns = [pa.array(x, pa.int64()) for x in (doc, start, size, crc, tokens)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    if with_ids:  # pieces follow each other as the ids do
        ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
        flat = np.concatenate([np.empty(0, "<u4"), *held]).astype(np.int32)
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names=names)


def pieces(docs: DataFrame, longest: int = MAX_LENGTH, vocabulary: str = "byte_bpe_50k.json",
           with_ids: bool = False) -> DataFrame:
    """One row per binary piece of every document (doc_id, text): its start
    among the document's ids, length, checksum and, if asked, the ids.

    A document is its text's ids and then the id 1, so a null or empty text is
    one piece of one id.  Repeated rows are packed each by itself; a null
    doc_id stays null.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                yield pieces_of(batch.slice(first, ROWS), encode, longest, with_ids)

    schema = T.StructType([*PIECES.fields, *([IDS] if with_ids else [])])
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return parallel(slim).mapInArrow(cut, schema)


def pack(docs: DataFrame, longest: int = MAX_LENGTH, vocabulary: str = "byte_bpe_50k.json",
         with_ids: bool = False) -> DataFrame:
    """Pieces with the sequence each forms: sequence_id (gapless from 0, equal
    lengths next to each other, longest bucket first) and offset (0).

    ``docs`` needs doc_id and text; further columns are ignored.  An empty
    table packs into an empty one.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")
    stored = materialize(pieces(docs, longest, vocabulary, with_ids), "pieces")
    slots = cumulative(stored, ["length"], ["doc_id", "start", "ids_crc32", "doc_tokens"], F.lit(1), "slot")
    # at most log2(longest) + 1 rows: one per bucket
    counts = {r.length: r.n for r in stored.groupBy("length").agg(F.count("*").alias("n")).collect()}
    first, at = [], 0
    for length in sorted(counts, reverse=True):
        first += [F.lit(length), F.lit(at)]
        at += counts[length]
    start = F.create_map(*first)[F.col("length")] if first else F.lit(0)
    return slots.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                        (start + F.col("slot")).cast("long").alias("sequence_id"),
                        F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
