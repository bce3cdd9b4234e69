"""Mixing sources to target weights.

The words of a source's documents, laid end to end, are packed into blocks of
one fixed length (the last is shorter).  Every output shard draws from a
multinomial how many blocks it takes of each source; the slots a source gets
are numbered through all shards, and slot number j stands for block p(j) of the
source's pseudorandom permutation p (a new one for every pass through the
source).  Blocks are joined to slots by their index.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.llm.common import WORD, cumulative, materialize, parallel

BLOCK_WORDS = 2048
OUT_SHARDS = 64
MAX_REPEAT = 3
#: Up to so many sources the plan (totals, targets and draws) is made on the
#: driver; beyond it the plan is a table and the driver sees groups of sources.
MAX_SOURCES = 100_000
GROUP_SOURCES = 10_000
#: Slots that travel as one row before they are listed.
SLOT_RUN = 10_000


def targets(sizes: list[int], weights: list[float], repeat: int = MAX_REPEAT) -> list[float]:
    """Shares of sum(sizes) by weight; a target stops at ``repeat`` times its
    source's size and the excess is reshared by weight among the others."""
    out = [0.0] * len(sizes)
    free = [i for i, s in enumerate(sizes) if s > 0]
    rest = float(sum(sizes))
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = [i for i in free if unit * weights[i] > repeat * sizes[i]]
        if not full:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in full:
            out[i] = float(repeat * sizes[i])
            rest -= out[i]
        free = [i for i in free if i not in set(full)]
    return out


class Permutation:
    """A pseudorandom permutation of 0..n-1 that needs no table: a four-round
    Feistel network on the next even number of bits, walked until it falls
    below n."""

    def __init__(self, n: int, seed: tuple[int, ...]):
        self.n = n
        self.half = np.uint64(max(1, ((max(1, n - 1)).bit_length() + 1) // 2))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        self.keys = np.random.SeedSequence(seed).generate_state(4, np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        h = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h >> np.uint64(32)) & self.mask

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, np.uint64).copy()
        todo = np.arange(len(x))
        while len(todo):
            left, right = x[todo] >> self.half, x[todo] & self.mask
            for key in (self.keys[::-1] if back else self.keys):
                if back:
                    left, right = right ^ self._mix(left, key), left
                else:
                    left, right = right, left ^ self._mix(right, key)
            x[todo] = (left << self.half) | right
            todo = todo[x[todo] >= np.uint64(self.n)]
        return x.astype(np.int64)

    def at(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, back=False)

    def slot_of(self, block: int) -> int:
        return int(self._walk(np.array([block]), back=True)[0])


@dataclass(frozen=True)
class SourcePlan:
    """How many slots a source fills so that its words come to ``words``: the
    last slot takes only ``last`` words of its block."""

    number: int
    size: int
    words: int
    blocks: int
    slots: int
    last: int


def plan_source(number: int, size: int, words: int, block: int, seed: int) -> SourcePlan:
    blocks = -(-size // block)
    if not words or not blocks:
        return SourcePlan(number, size, 0, blocks, 0, 0)
    passes, rest = divmod(words, size)
    if not rest:
        return SourcePlan(number, size, words, blocks, passes * blocks, block)
    short = block - (size - (blocks - 1) * block)  # what the last block lacks
    tail = Permutation(blocks, (seed, number, passes)).slot_of(blocks - 1)
    held = lambda m: m * block - (short if tail < m else 0)
    m = -(-rest // block)
    while held(m) < rest:
        m += 1
    return SourcePlan(number, size, words, blocks, passes * blocks + m, rest - held(m - 1))


def draw_shards(slots: list[int], seed: int | tuple[int, ...], shards: int, wants: list[int] | None = None) -> np.ndarray:
    """(shards, sources): blocks that every output shard takes of each source.
    A shard's counts are one multinomial draw with the shares of what is still
    to be placed; what a draw takes beyond that is drawn again, so the counts
    of all shards add up to the plan.  ``wants`` says how many blocks each shard
    takes in all; without it they take alike."""
    left = np.array(slots, np.int64)
    rng = np.random.default_rng(seed)
    out = np.zeros((shards, len(left)), np.int64)
    for k in range(shards):
        want = int(left.sum()) // (shards - k) if wants is None else int(wants[k])
        while want:
            got = np.minimum(rng.multinomial(want, left / left.sum()), left)
            out[k] += got
            left -= got
            want -= int(got.sum())
    return out


@dataclass(frozen=True)
class Mix:
    """``sources`` (source_no, source, source_size, target), ``documents``
    (source_no, at, ...: a document and its first word's place in its source)
    and ``taken`` (source_no, at, shard, slot, turn, start, words): the stretch
    of the document's words that a slot of an output shard holds; turn counts
    the passes through the source.  ``few``: there are at most MAX_SOURCES
    sources, so their table may be broadcast."""

    sources: DataFrame
    documents: DataFrame
    taken: DataFrame
    few: bool

    def per_source(self) -> DataFrame:
        return F.broadcast(self.sources) if self.few else self.sources


_RANGES = "shard int, source_no int, first long, n long, blocks long, slots long, last long"


def _range_rows(plans: list[SourcePlan], drawn: np.ndarray) -> list[tuple]:
    """A source's slots go to the shards one after another."""
    starts = np.cumsum(drawn, axis=0) - drawn
    return [(k, p.number, int(starts[k, j]), int(drawn[k, j]), p.blocks, p.slots, p.last)
            for j, p in enumerate(plans) for k in range(len(drawn)) if drawn[k, j]]


def _plan_on_driver(rows: list, weights: dict[str | None, float] | None, block: int, shards: int, repeat: int, seed: int):
    """Rows (source_no, source, source_size, target) and _RANGES of the sources
    (source, size), which are sorted."""
    by = [1 + i % 3 if weights is None else weights.get(r.source, 0) for i, r in enumerate(rows)]
    sizes = [int(r.size or 0) if w else 0 for r, w in zip(rows, by, strict=True)]
    goal = targets(sizes, by, repeat)
    plans = [plan_source(i, s, min(round(t), repeat * s), block, seed) for i, (s, t) in enumerate(zip(sizes, goal, strict=True))]
    drawn = draw_shards([p.slots for p in plans], seed, shards)
    sources = [(i, r.source, int(r.size or 0), float(t)) for i, (r, t) in enumerate(zip(rows, goal, strict=True))]
    return sources, _range_rows(plans, drawn)


def _numbered(found: DataFrame) -> DataFrame:
    """Sources with their place (from 0) by code point, null last: a range sort,
    and the rows of the parts before."""
    parts = max(2, found.sparkSession.sparkContext.defaultParallelism)
    order = F.col("source").asc_nulls_last()
    placed = found.repartitionByRange(parts, order).sortWithinPartitions(order).select(
        "source", "size", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    placed = materialize(placed, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.join(F.broadcast(starts), "part").select((F.col("start") + F.col("at")).cast("int").alias("source_no"), "source", "size")


def _plan_in_table(found: DataFrame, weights: dict[str | None, float] | None, block: int, shards: int, repeat: int, seed: int):
    """The tables that ``_plan_on_driver`` makes rows of, for any number of
    sources: the level that fills the targets is found by aggregates, a source's
    plan is a row, and the multinomial draws go first to groups of sources (on
    the driver: a row for GROUP_SOURCES sources) and then, inside a group, to
    its sources."""
    spark = found.sparkSession
    rows = _numbered(found)
    if weights is None:
        rows = rows.withColumn("weight", (1 + F.col("source_no") % 3).cast("double"))
    else:
        by = spark.createDataFrame([(s, float(w)) for s, w in weights.items()], "_source string, weight double")
        rows = rows.join(by, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source").fillna(0.0, ["weight"])
    size = F.when(F.col("weight") > 0, F.coalesce("size", F.lit(0))).otherwise(0)
    rows = materialize(rows.withColumn("used", size), "weights")
    free, limit = rows.where("used > 0"), F.col("used") * repeat
    total, heavy = free.agg(F.sum("used"), F.sum("weight")).first()
    level = total / heavy if heavy else 0.0
    while True:  # the level only rises, as sources reach their limit
        full = F.lit(level) * F.col("weight") > limit
        held, heavy = free.agg(F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        risen = (total - held) / heavy if heavy else level
        if risen <= level:
            break
        level = risen
    goal = F.when(F.col("used") == 0, 0.0).when(F.lit(level) * F.col("weight") > limit, limit.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    rows = rows.withColumn("target", goal)

    def plan(batches):
        for b in batches:
            plans = [plan_source(int(i), int(s), min(round(t), repeat * int(s)), block, seed)
                     for i, s, t in zip(b["source_no"], b["used"], b["target"], strict=True)]
            yield b[["source_no", "used"]].assign(words=[p.words for p in plans], blocks=[p.blocks for p in plans],
                                                  slots=[p.slots for p in plans], last=[p.last for p in plans])
    plans = rows.select("source_no", "used", "target").mapInPandas(
        plan, "source_no int, used long, words long, blocks long, slots long, last long")
    plans = materialize(plans.withColumn("band", F.floor(F.col("source_no") / GROUP_SOURCES)), "plans")
    bands = plans.groupBy("band").agg(F.sum("slots").alias("slots")).orderBy("band").collect()
    drawn = draw_shards([r.slots for r in bands], seed, shards)
    wants = spark.createDataFrame([(r.band, [int(x) for x in drawn[:, j]]) for j, r in enumerate(bands)], "band long, wants array<long>")

    def draw(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("source_no")
        own = [SourcePlan(*map(int, r)) for r in p[["source_no", "used", "words", "blocks", "slots", "last"]].itertuples(index=False)]
        got = draw_shards([x.slots for x in own], (seed, int(p["band"].iloc[0])), shards, list(p["wants"].iloc[0]))
        return pd.DataFrame(_range_rows(own, got), columns=["shard", "source_no", "first", "n", "blocks", "slots", "last"])
    ranges = plans.join(F.broadcast(wants), "band").groupBy("band").applyInPandas(draw, _RANGES)
    sources = rows.select("source_no", "source", F.coalesce("size", F.lit(0)).alias("source_size"), "target")
    return sources, materialize(ranges, "ranges")


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, block: int = BLOCK_WORDS,
        shards: int = OUT_SHARDS, repeat: int = MAX_REPEAT, seed: int = 29, max_sources: int = MAX_SOURCES) -> Mix:
    """The mix of stored ``docs`` (columns doc_id, source, size, tie and any
    more; read several times).

    weights: by source; None gives the sources, by code point with null last,
    1, 2, 3 and so on again.  A source that weights does not name gets 0.
    Documents of size 0 hold no words and are never taken.  Beyond
    ``max_sources`` sources the plan is a table: the same targets and taken
    words by source, other draws.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("size"))
    rows = found.orderBy(F.col("source").asc_nulls_last()).limit(max_sources + 1).collect()
    few, cores = len(rows) <= max_sources, spark.sparkContext.defaultParallelism
    if few:
        listed, table = _plan_on_driver(rows, weights, block, shards, repeat, seed)
        sources = spark.createDataFrame(listed, "source_no int, source string, source_size long, target double")
        ranges, parts = spark.createDataFrame(table, _RANGES), max(1, min(len(table), cores))
    else:
        (sources, ranges), parts = _plan_in_table(found, weights, block, shards, repeat, seed), cores
    named = sources.select("source_no", F.col("source").alias("_source"))
    named = F.broadcast(named) if few else named
    numbered = docs.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    if not few:  # read three times
        numbered = materialize(numbered, "numbered")
    documents = cumulative(numbered, ["source_no"], ["doc_id", "tie"], F.col("size"), "at")

    def to_blocks(batches):
        for b in batches:
            out = np.empty(len(b), np.int64)
            turn = b["slot"] // b["blocks"]
            for (src, t), own in b.groupby([b["source_no"], turn], sort=False).indices.items():
                n = int(b["blocks"].iloc[own[0]])
                out[own] = Permutation(n, (seed, int(src), int(t))).at(b["slot"].to_numpy()[own] % n)
            yield pd.DataFrame({"source_no": b["source_no"], "block": out, "shard": b["shard"], "slot": b["slot"], "turn": turn,
                                "limit": np.where(b["slot"] == b["slots"] - 1, b["last"], block)})
    # A run of slots is a row until it is listed, so no array grows with a source.
    end = F.col("first") + F.col("n")
    runs = ranges.select("shard", "source_no", "blocks", "slots", "last", end.alias("end"),
                         F.explode(F.sequence("first", end - 1, F.lit(SLOT_RUN).cast("long"))).alias("run"))
    slots = runs.repartition(parts, "shard", "source_no", "run").select(
        "shard", "source_no", "blocks", "slots", "last", F.explode(F.sequence("run", F.least(F.col("run") + SLOT_RUN, "end") - 1)).alias("slot"))
    slots = slots.mapInPandas(to_blocks, "source_no int, block long, shard int, slot long, turn long, limit long")

    # Pieces: what every block holds of a document, as (place in block, words).
    word = documents.where("size > 0").select("source_no", "at", "size")
    first, last = F.col("at"), F.col("at") + F.col("size")
    pieces = word.select("source_no", "at", "size", F.explode(F.sequence(F.floor(first / block), F.floor((last - 1) / block))).alias("block"))
    low = F.greatest(F.col("at"), F.col("block") * block)
    high = F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("source_no", "at", "block", (low - F.col("block") * block).alias("place"),
                           (low - F.col("at")).alias("start"), (high - low).alias("n"))
    words = F.least("n", F.col("limit") - F.col("place"))
    taken = pieces.join(slots, ["source_no", "block"]).where("place < limit").select(
        "source_no", "at", "shard", "slot", "turn", "start", words.alias("words"))
    return Mix(sources, documents, taken, few)


def sized(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and a tie-breaker."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return parallel(docs).select("doc_id", "source", *more, size.alias("size"), F.xxhash64("text").alias("tie"))


def mix_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of docs (doc_id,
    source, text): the words that the mix takes of it, repeats counted.
    Repeated rows count each by itself; an empty table mixes into an empty
    one."""
    m = mix(materialize(sized(docs), "sizes"), **options)
    sums = m.taken.groupBy("source_no", "at").agg(F.sum("words").alias("taken"))
    # documents without words share their place with the next one
    sums = sums.withColumn("holds", F.lit(True))
    out = m.documents.withColumn("holds", F.col("size") > 0).join(sums, ["source_no", "at", "holds"], "left")
    out = out.join(m.per_source().drop("source"), "source_no")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: for every document and pass, each unbroken stretch
    of words that the mix takes is a row with the document's columns, its text
    cut to the stretch (whole when all words are taken) and ``n_chars``, if
    there, counted anew.  doc_id repeats with the passes."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("rec")
    m = mix(materialize(sized(docs, whole), "mix-documents"), **options)
    held = F.array_sort(F.collect_list(F.struct("start", "words")))
    turns = m.taken.groupBy("source_no", "at", "turn").agg(held.alias("parts"))

    @F.pandas_udf("array<string>")
    def stretches(text: pd.Series, parts: pd.Series) -> pd.Series:
        import re
        word = re.compile(WORD)
        out = []
        for t, ps in zip(text, parts, strict=True):
            runs: list[list[int]] = []
            for p in ps:
                if runs and runs[-1][1] == p["start"]:
                    runs[-1][1] += p["words"]
                else:
                    runs.append([p["start"], p["start"] + p["words"]])
            spans = [w.span() for w in word.finditer(t)]
            out.append([t] if runs == [[0, len(spans)]] else [t[spans[a][0]:spans[b - 1][1]] for a, b in runs])
        return pd.Series(out, dtype=object)
    rows = m.documents.where("size > 0").select("source_no", "at", "rec").join(turns, ["source_no", "at"])
    rows = rows.select("rec", F.explode(stretches("rec.text", "parts")).alias("cut"))
    types = dict(docs.dtypes)
    new = {"text": F.col("cut"), "n_chars": F.length("cut").cast(types.get("n_chars", "long"))}
    return rows.select(*[new.get(c, F.col("rec").getField(c)).alias(c) for c in docs.columns])
