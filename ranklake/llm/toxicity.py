"""Toxicity by averaged subword-bag embeddings and a linear softmax.

A word is the bag of its n-grams (of bytes) and of itself, hashed into buckets;
its vector is the mean of the buckets' embeddings, and a text's vector the mean
of its words' vectors, which a linear softmax over two classes scores.  Buckets
and softmax are trained together in numpy; a misspelt word that no training
text holds shares most of its n-grams with the word.

Scoring needs no vectors: the softmax is linear, so a bucket counts by one
number and a text's margin is the mean of its words' numbers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm.common import materialize, parallel

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
#: Bytes between words: blanks, and marks that stand beside words.
BETWEEN = b" \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>"
#: Texts are hashed in groups of about so many bytes.
GROUP_BYTES = 256 << 10
#: The classifier is fitted on at most this many labelled rows that are toxic,
#: and that are not, chosen by a hash of doc_id.
TRAIN_TOXIC, TRAIN_CLEAN = 1200, 3000
THRESHOLD = 0.7
#: A bucket counts in full from this chi-squared on (a level of 10^-7, against the
#: number of buckets looked at), and the less the further it stays below.
EVIDENCE = 28.0
#: A false alarm costs as much as so many toxic texts found, rate for rate.
ALARM = 4.0
#: With fewer rows of a class, the threshold is placed by cross-validation.
FEW = 100


_APART = np.zeros(256, bool)
_APART[list(BETWEEN)] = True
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    """Buckets of 32-bit hashes."""
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    return h >> np.uint32(32 - BITS)


def parts(texts: list[str | None], keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, weight) of every word and n-gram of the texts: a
    word's vector is the mean of its parts, a text's the mean of its words.
    N-grams are of the lower-cased bytes with one edge mark on either side of a
    word.  ``keep`` marks the buckets that are wanted."""
    laid = [(t or "").lower().encode("utf-8", "replace") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(laid) + b"\n", np.uint8)
    edges = np.cumsum([1 + len(x) for x in laid])  # where each text ends
    apart = _APART[data]
    first = np.flatnonzero(~apart[1:] & apart[:-1]) + 1
    last = np.flatnonzero(apart[1:] & ~apart[:-1]) + 1
    if not len(first):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0)
    size = last - first
    owner = np.searchsorted(edges, first, side="right")
    count = 1 + sum(np.maximum(0, size + 3 - n) for n in GRAMS)
    weight = 1 / (count * np.bincount(owner, minlength=len(texts))[owner])
    x = data.astype(np.uint32)
    x[apart] = 32
    found, words = [], []
    h, inside = x[:-1] * np.uint32(0x01000193) + x[1:], None
    for n in range(3, GRAMS[-1] + 1):
        h = h[:-1] * np.uint32(0x01000193) + x[n - 1:]
        inside = apart[1:-1] if inside is None else inside[:-1] | apart[n - 2:-1]
        if n in GRAMS:
            bucket = _mixed(h)
            take = ~inside if keep is None else keep[bucket] & ~inside
            at = np.flatnonzero(take)
            found.append(bucket[at])
            words.append(np.searchsorted(first, at + 1, side="right") - 1)
    # whole words: a polynomial of the bytes, from sums up to each place
    power = np.multiply.accumulate(np.full(int(size.max()), _TIMES))
    span = np.repeat(np.arange(len(first)), size)
    place = np.arange(len(span)) - np.repeat(np.cumsum(size) - size, size)
    whole = np.add.reduceat(x[first[span] + place].astype(np.uint64) * power[place], np.cumsum(size) - size)
    bucket = _mixed(((whole * _TIMES) >> np.uint64(32)).astype(np.uint32))
    at = np.arange(len(first)) if keep is None else np.flatnonzero(keep[bucket])
    found.append(bucket[at])
    words.append(at)
    word = np.concatenate(words)
    return owner[word], np.concatenate(found).astype(np.int64), weight[word]


def groups(texts: list[str | None]) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of texts of about GROUP_BYTES, with the number of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= GROUP_BYTES:
            yield at, texts[at:i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def text_bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of every text and the share each has in its average."""
    out = []
    for _, some in groups(texts):
        owner, bucket, weight = parts(some)
        key, at = np.unique(owner * BUCKETS + bucket, return_inverse=True)
        share = np.bincount(at, weight) if len(at) else np.zeros(0)
        cut = np.searchsorted(key, np.arange(1, len(some)) * BUCKETS)
        out += list(zip(np.split((key % BUCKETS).astype(np.int32), cut), np.split(share.astype(np.float32), cut), strict=True))
    return out


@dataclass
class Model:
    """``margin`` of every bucket and the margin of an empty text."""

    margin: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """0 to 1 for every text; a text without words has the bias alone."""
        keep = self.margin != 0
        out = np.full(len(texts), self.bias)
        for at, some in groups(texts):
            owner, bucket, weight = parts(some, keep)
            out[at:at + len(some)] += np.bincount(owner, self.margin[bucket] * weight, len(some))
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


def strength(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int) -> np.ndarray:
    """How far each of ``n`` buckets may move, above 0 to 1: the squared share of
    EVIDENCE that its chi-squared has."""
    held = np.zeros((2, n))
    for (i, _), k in zip(bags, labels, strict=True):
        held[k, i] += 1
    n0, n1 = (float((labels == k).sum()) for k in (0, 1))
    b, a = held
    chi = (n1 + n0) * (a * n0 - b * n1) ** 2 / np.maximum(1, n1 * n0 * (a + b) * (n1 + n0 - a - b))
    return np.maximum(np.minimum(1, chi / EVIDENCE) ** 2, 1e-6)


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n: int, dim: int, epochs: int,
            rate: float, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """Margins of the ``n`` buckets and the bias, by Adagrad on the log loss,
    classes weighted alike, the step falling to 0.  With two classes only the
    difference ``v`` of the softmax's rows counts, so an embedding's gradient is
    a multiple of it."""
    order = rng.permutation(len(labels))
    counts = np.bincount(labels, minlength=2)
    s = strength(bags, labels, n)
    e = rng.uniform(-0.1, 0.1, (n, dim)) / dim
    v = rng.uniform(-1, 1, dim) / dim - rng.uniform(-1, 1, dim) / dim
    b = 0.0
    past = np.full(n, 1e-8)
    cost = (0.5 * len(labels) / np.maximum(counts, 1))[labels]
    batches = []
    for at in range(0, len(order), 32):
        rows = order[at:at + 32]
        ids = np.concatenate([bags[r][0] for r in rows])
        ws = np.concatenate([bags[r][1] for r in rows]) * s[ids]
        hit, inv = np.unique(ids, return_inverse=True)
        batches.append((rows, [len(bags[r][0]) for r in rows], hit, inv.astype(np.int32), ws.astype(np.float32)))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in rng.permutation(len(batches)):
            rows, sizes, hit, inv, ws = batches[at]
            doc = np.repeat(np.arange(len(rows)), sizes)
            own = e[hit]
            z = np.bincount(doc, (own @ v)[inv] * ws, len(rows)) + b
            q = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows]) * cost[rows] / len(rows)
            g = np.bincount(inv, q[doc] * ws, len(hit))
            past[hit] += g * g * (v @ v) / dim
            e[hit] = own - (step * g / np.sqrt(past[hit]))[:, None] * v
            v = v - 0.4 * step * (g @ own)
            b -= 0.4 * q.sum()
    return (e @ v) * s, float(b)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 80,
          rate: float = 3.0, seed: int = 3) -> Model:
    """Embeddings and softmax of all buckets of the rows, held back by
    ``strength``.  A fifth of the rows only serves to place the margin at which
    the score is THRESHOLD; where a class has fewer than FEW rows, every fifth
    does so in turn and the model is trained on all.  With labels of one class
    only, or none, every text gets that class (none: not toxic); where no margin
    tells the classes apart, none is toxic."""
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        return Model(np.zeros(BUCKETS), 4.0 if labels.any() else -4.0)
    rng = np.random.default_rng(seed)
    number = np.zeros(BUCKETS, np.int32)
    for i, _ in bags:
        number[i] = 1
    known = np.flatnonzero(number)
    number[known] = np.arange(len(known))
    bags = [(number[i], w) for i, w in bags]
    fold = np.zeros(len(labels), int)
    for k in (0, 1):
        own = rng.permutation(np.flatnonzero(labels == k))
        fold[own] = np.arange(len(own)) % 5
    few = np.bincount(labels).min() < FEW
    x = np.full(len(labels), np.nan)
    for f in range(5 if few else 1):
        rows = np.flatnonzero(fold != f)
        if len(set(labels[rows].tolist())) == 2:
            m, b = descend([bags[r] for r in rows], labels[rows], len(known), dim, epochs, rate, rng)
            for r in np.flatnonzero(fold == f):
                x[r] = m[bags[r][0]] @ bags[r][1] + b
    if few:
        m, b = descend(bags, labels, len(known), dim, epochs, rate, rng)
    held = np.flatnonzero(~np.isnan(x))
    if len(set(labels[held].tolist())) < 2:
        return Model(np.zeros(BUCKETS), -4.0)
    cut, scale = best_cut(x[held], labels[held])
    found, alarms = (np.mean(x[held][labels[held] == k] > cut) for k in (1, 0))
    if found <= ALARM * alarms:
        return Model(np.zeros(BUCKETS), -4.0)
    margin = np.zeros(BUCKETS)
    margin[known] = m * scale
    return Model(margin, float((b - cut) * scale + np.log(THRESHOLD / (1 - THRESHOLD))))


def best_cut(x: np.ndarray, y: np.ndarray, alarm: float = ALARM) -> tuple[float, float]:
    """Middle of the widest range of margins with the best rate of toxic texts
    found less ``alarm`` times the rate of false alarms, and the scale that
    puts the classes' medians 6 apart."""
    order = np.argsort(x, kind="stable")
    gap = abs(np.median(x[y == 1]) - np.median(x[y == 0]))
    x, y = x[order], y[order]
    good = np.concatenate([[0], np.cumsum(np.where(y == 0, alarm / max(1, (y == 0).sum()), -1 / max(1, (y == 1).sum())))])
    edges = np.concatenate([[x[0] - gap], x, [x[-1] + gap]])
    best = np.flatnonzero(good >= good.max() - 1e-12)
    k = best[np.argmax(edges[best + 1] - edges[best])]
    return float((edges[k] + edges[k + 1]) / 2), float(6 / max(gap, 1e-9))


def is_held_out(doc_id) -> F.Column:
    rest = F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3
    return F.coalesce(rest == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN) -> Model:
    """A model of labelled documents (doc_id, text; doc_id, toxic) outside the
    held-out third, at most ``toxic`` and ``clean`` of them.  All buckets of
    these rows are trained."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~is_held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    pick = lambda k, n: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = pick(1, toxic).unionByName(pick(0, clean))  # few rows, by the parameters
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = text_bags(b["text"].tolist())
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "ids": [i.tobytes() for i, _ in got], "ws": [w.tobytes() for _, w in got]})
    data = materialize(rows.mapInPandas(bags, "doc_id long, toxic int, ids binary, ws binary"), "bags")
    # a partition at a time and as bytes: the driver holds each bag once
    few = [(zlib.crc32(str(r.doc_id).encode()), r.doc_id, zlib.crc32(r.ids), zlib.crc32(r.ws), r.toxic,
            np.frombuffer(r.ids, np.int32), np.frombuffer(r.ws, np.float32)) for r in data.toLocalIterator()]
    few.sort(key=lambda r: r[:4])
    return train([r[5:] for r in few], np.array([r[4] for r in few], np.int64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns with text) and ``score`` of every whole text; a
    null or blank text has the model's score of no words.  A column of that
    name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast((model.margin.astype(np.float32), model.bias))

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = Model(*shared.value)
        for b in batches:
            yield pd.Series(model.scores(b.tolist()))
    return parallel(docs).withColumn("score", scores("text"))


def score_digest(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs (doc_id,
    text).  A null doc_id is not held out; without usable labels of both
    classes every text gets one score on the safe side."""
    out = score(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score",
                      F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (any columns with text) without the rows that score THRESHOLD
    or more."""
    rows = score(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec"), "text"), model)
    return rows.where(F.col("score") < THRESHOLD).select("rec.*")
