"""Spelling variants grouped through an index of variable-length grams.

A word is decomposed into variable grams: from each place the shortest gram of
``SHORTEST`` characters or more that is rare, which the dictionary of frequent
grams decides (a frequent gram is lengthened until it is rare, reaches
``LONGEST`` or the word ends); a gram inside an earlier one is left out.  One
edit can change only some of a word's grams.  The largest number, over all
places of the edit, is the word's affected-gram bound: every near word shares
all its other grams.  So only the lists of a word's bound + 1 rarest grams are
merged; a near word stands in one of them, at the same distance from the
word's start or end, and must be able to share as many grams as both bounds
ask for.  Survivors are verified by their edit distance.

A word whose bound leaves no gram untouched meets the others of that kind
through its grams of fixed length, of which one edit always leaves some.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.llm.common import materialize, parallel

# Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT, FACTOR, EVERY = 7, 2, 10, 31

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Lengths of the grams.
SHORTEST, LONGEST = 3, 5
#: A gram that stands more often than this is frequent, unless the dictionary
#: would pass ``MOST_GRAMS`` entries: then the limit rises with the words.
RARE = 500
MOST_GRAMS = 100_000
#: Entries a task counts before it hands them on.
HELD = 200_000

FIRST, LAST = "\x02", "\x03"  # marks of a word's start and end


def altered(run: str, crc: int, every: int = EVERY) -> str:
    """The run, or the run without one code point if ``every`` divides crc."""
    at = crc % len(run)
    return run if crc % every else run[:at] + run[at + 1:]


def counted(texts: Iterator[tuple[str | None, bytes | None]], least: int) -> Iterator[Counter]:
    """Words of some documents (id, UTF-8 text) with their counts, in parts of
    about ``HELD`` entries."""
    # a run shorter than the least length gives no word, nor does what an
    # alteration leaves of it
    runs = re.compile(RUN.replace("A-Z", "").replace("+", "{%d,}" % least))
    total: Counter = Counter()
    for doc, text in texts:
        if not text:
            continue
        start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
        for run, n in Counter(runs.findall(text.translate(_LOWER).decode())).items():
            word = altered(run, zlib.crc32(run.encode(), start))
            if len(word) >= least:
                total[word] += n
        if len(total) > HELD:
            yield total
            total = Counter()
    yield total


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, at_least: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) of ``least`` code points or
    more that occur ``at_least`` times."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = ((d, t) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for part in counted(texts, least):
            yield pa.RecordBatch.from_arrays([pa.array(part.keys(), pa.string()), pa.array(part.values(), pa.int64())], names=["word", "n"])

    slim = docs.select(F.col("doc_id").cast("string"), F.encode("text", "UTF-8").alias("text"))
    parts = parallel(slim).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= at_least)


def gram_dictionary(words: DataFrame, rare: int = RARE, most: int = MOST_GRAMS) -> dict[str, int]:
    """Frequent grams (``SHORTEST`` to ``LONGEST`` characters) of the words with
    their counts.  A gram is kept if it stands more than a limit of times; the
    limit is chosen so that no more than ``most`` grams can pass it."""
    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array(c.values(), pa.int64())], names=["gram", "n"])
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                s = FIRST + word + LAST
                for q in range(SHORTEST, LONGEST + 1):
                    total.update([s[i:i + q] for i in range(len(s) - q + 1)])
                if len(total) > HELD:
                    yield out(total)
                    total = Counter()
        yield out(total)

    places = words.agg(F.sum(F.length("word") + 2)).first()[0] or 0
    limit = max(rare, math.ceil(places * (LONGEST - SHORTEST + 1) / most))
    found = words.select("word").mapInArrow(grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram: r.n for r in found.where(F.col("n") > limit).collect()}  # at most ``most`` rows


def decompose(s: str, frequent: dict[str, int]) -> list[tuple[int, int]]:
    """Places (first, last) of the variable grams of a marked word."""
    out, end, n = [], -1, len(s)
    for p in range(n - SHORTEST + 1):
        q = SHORTEST
        while q < LONGEST and p + q < n and s[p:p + q] in frequent:
            q += 1
        if p + q - 1 > end:
            end = p + q - 1
            out.append((p, end))
    return out


def tails(frequent: dict[str, int]) -> set[str]:
    """Proper suffixes of the grams that are lengthened."""
    return {g[k:] for g in frequent if len(g) < LONGEST for k in range(1, len(g) + 1)}


def affected(s: str, grams: list[tuple[int, int]], suffixes: set[str]) -> int:
    """Most grams that one edit of a marked word can change.

    A gram before the edit stays: its own characters fix it.  A gram that holds
    the place changes.  A gram behind it stays unless a gram that starts at the
    edit or before comes to enclose it, for which what lies between the edit and
    the gram's last character must end a frequent gram."""
    most = near = 0
    for i in range(1, len(s)):
        while near < len(grams) and grams[near][1] < i:
            near += 1
        held = cut = 0  # one character replaced or deleted; one inserted before it
        for p, e in islice(grams, near, None):
            if e > i + LONGEST:  # nothing that frequent reaches so far
                break
            if p > i:
                held += s[i + 1:e] in suffixes
                cut += s[i:e] in suffixes
            else:
                held += 1
                cut += p < i or s[i:e] in suffixes
        most = max(most, cut, held if i < len(s) - 1 else 0)
    return most


def letters(word: str) -> int:
    """Which letters a word holds once and twice, as 64 bits: an edit changes
    two of them at most."""
    bits = 0
    for c, n in Counter(word).items():
        k = ord(c) % 32
        bits |= 1 << k if n == 1 else (1 << k | 1 << k + 32)
    return bits - (1 << 64) if bits >> 63 else bits


SIGNATURE = T.StructType([
    T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("letters", T.LongType()),
    T.StructField("fixed", T.BooleanType()), T.StructField("shared", T.IntegerType()), T.StructField("gram", T.StringType()),
    T.StructField("at", T.IntegerType()), T.StructField("rest", T.IntegerType()),
])


def signature(s: str, frequent: dict[str, int], grams: list[tuple[int, int]], bound: int) -> list[tuple[int, str, int, int]]:
    """(shared, gram, at, rest) of the ``bound`` + 1 rarest grams of a marked
    word: how many grams a near word shares, and how many of the word's grams
    come after this one in the order of rareness."""
    order = sorted((frequent.get(s[p:e + 1], 0), s[p:e + 1], p) for p, e in grams)
    return [(max(0, len(grams) - bound), g, p, len(grams) - 1 - k) for k, (_, g, p) in enumerate(order[:bound + 1])]


def signatures(words: DataFrame, frequent) -> DataFrame:
    """The signature rows of every word of words (word, n).  A word whose bound
    leaves no gram also has ``fixed`` rows, of grams of the shortest length."""
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = frequent.value
        suffixes = tails(known)
        for frame in frames:
            out = []
            for word, n in zip(frame["word"], frame["n"], strict=True):
                s, mask = FIRST + word + LAST, letters(word)
                grams = decompose(s, known)
                bound = affected(s, grams, suffixes)
                out += [(word, n, mask, False, *x) for x in signature(s, known, grams, bound)]
                if bound >= len(grams):
                    grams = decompose(s, {})
                    out += [(word, n, mask, True, *x) for x in signature(s, {}, grams, affected(s, grams, set()))]
            yield pd.DataFrame(out, columns=SIGNATURE.names)

    return words.select("word", "n").mapInPandas(cut, SIGNATURE)


def near_pairs(found: DataFrame) -> DataFrame:
    """Pairs (a, an, b, bn) of words one edit apart, of words given by their
    signature rows; a is the shorter or, among equals, the smaller word."""
    size = F.length("word")
    place = lambda side, at, size: F.struct(F.lit(side).alias("side"), at.alias("at"), size.alias("size"))
    start, end = F.col("at"), size - F.col("at")
    # A gram before the edit keeps its distance from the start, one behind it
    # from the end; the longer word has one character more.
    short = [place(0, start, size), place(0, start, size + 1), place(1, end, size + 1)]
    long = [place(0, start, size), place(1, end, size)]

    def listed(places, side: str) -> DataFrame:
        # a chance collision of keys adds a candidate, which is verified
        return found.withColumn("_p", F.explode(F.array(*places))).select(
            F.xxhash64("fixed", "gram", "_p").alias("key"),
            *[F.col(c).alias(side + c) for c in ("word", "n", "letters")],
            (F.shiftleft(F.col("rest").cast("long"), 32) + F.col("shared")).alias(f"{side}room"))

    rest = lambda c: F.shiftright(c, 32)
    shared = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    fits = ((F.bit_count(F.col("sletters").bitwiseXOR(F.col("lletters"))) <= 2)
            & (F.least(rest("sroom"), rest("lroom")) + 1 >= F.greatest(shared("sroom"), shared("lroom")))
            & (F.struct(F.length("sword"), "sword") < F.struct(F.length("lword"), "lword"))
            & (F.levenshtein("sword", "lword", 1) == 1))
    a, b = listed(short, "s").alias("x"), listed(long, "l").alias("y")
    return a.join(b, (F.col("x.key") == F.col("y.key")) & fits).select(
        F.col("sword").alias("a"), F.col("sn").alias("an"), F.col("lword").alias("b"), F.col("ln").alias("bn"))


def near_words(words: DataFrame, rare: int = RARE) -> DataFrame:
    """Every pair of near words of words (word, n) once."""
    frequent = words.sparkSession.sparkContext.broadcast(gram_dictionary(words, rare))
    return near_pairs(materialize(signatures(parallel(words), frequent), "signatures")).distinct()


def group(words: DataFrame, factor: int = FACTOR, rare: int = RARE) -> DataFrame:
    """word, n, n_near, form, form_n and root of every row of words (word, n;
    a word once).

    The form is the near word of largest n (ties: the smallest) if that is
    ``factor`` (2 or more) times the word's n or more.  The root is the last word
    that forms lead to."""
    pairs = materialize(near_words(words, rare), "near-words")
    other = lambda n, w: F.struct((-F.col(n)).alias("down"), F.col(w).alias("word")).alias("other")
    sides = pairs.select(F.col("a").alias("word"), other("bn", "b")).unionAll(pairs.select(F.col("b").alias("word"), other("an", "a")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    best = best.select("word", "n_near", (-F.col("best.down")).alias("best_n"), F.col("best.word").alias("best_word"))
    rows = words.join(best, "word", "left").withColumn("form_n", F.when(F.col("best_n") >= factor * F.col("n"), F.col("best_n")))
    rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                       F.when(F.col("form_n").isNotNull(), F.col("best_word")).alias("form"), "form_n")
    rows = materialize(rows, "forms")
    # Each step multiplies n by the factor, so paths are short; a round doubles
    # the part of them that is known.
    largest = rows.agg(F.max("n")).first()[0] or 1
    to = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(2, math.log(max(2, largest), factor) + 1)))):
        step = to.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        to = materialize(to.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "roots")
    return rows.join(to, "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = LEAST_LENGTH, at_least: int = LEAST_COUNT, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs (doc_id, text).

    Every row is a document by itself, so repeated rows count again; a null or
    empty text has no word; a null doc_id stands as an empty one before the
    colon.  Further columns are ignored.  An empty table gives an empty one."""
    words = materialize(word_counts(docs, least, at_least), "words")
    return group(words, factor).select("word", "form", "root", "n", "n_near", "form_n")
