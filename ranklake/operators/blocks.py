"""Exact top-k of many plain requests without a row per (request, document).

Full scoring in Spark makes a row of every document that shares a term with a
request, and every shard sends its own best rows. Where requests and documents
both grow, that is their product. Here a task takes a block of requests, reads
the documents that can be results group by group and keeps the best rows of its
requests only; nothing but requests, documents and results is moved or stored.

1. ``numbered_rows``: the result rows (mapping rows that pass a language which
   is asked for) are numbered by (doc_id, file_pos), the order that breaks ties.
2. ``weighted_requests``: a row per request with its terms' weights.
3. ``packed_documents``: a row per document with its postings of asked terms.
4. Every block of requests meets all documents of its index in one task
   (``_Block``): frequent terms by a matrix product, the others by their
   posting lists, then the best ``limit`` rows by (score, number).

It answers requests whose clauses are all terms, optional, required or
prohibited (``plain_requests``), with the rows that ``evaluate``,
``result_hits`` and ``topk_hits`` give.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.config import BLOCK_ROWS, BROADCAST_MAX_ROWS, GROUP_POSTINGS, K1, B
from ranklake.functions.bm25 import idf
from ranklake.operators.enrich import by_document, lang_filter_cond
from ranklake.operators.joins import salt_replicate, salt_spread
from ranklake.operators.postings import SearchIndex
from ranklake.operators.scoring import SCORE_DIGITS, TERM_SALTS, _occ

#: Requests that are scored at once against a group of documents.
BATCH = 128
#: A term that so large a part of a group's documents hold is a row of a matrix.
DENSE = 0.25
MAX_DENSE = 128
UNIT = 10.0 ** SCORE_DIGITS
#: Requests whose clauses a task weighs.
TASK_REQUESTS = 10_000


def said(clauses: DataFrame) -> DataFrame:
    """What is read of clauses again and again, stored: (request_id, plain, occ,
    text, boost), ``plain`` where a clause is a term."""
    return clauses.select("request_id", (F.col("kind") == "term").alias("plain"), _occ(), "text", "boost").checkpoint(eager=True)


def plain_requests(valid: DataFrame, clauses: DataFrame) -> DataFrame:
    """The request_ids whose clauses (``said``) are all terms and whose rows, if an
    id comes more than once, agree on index and limit. No others are answered here."""
    other = clauses.where("NOT plain").select("request_id").distinct()
    one = valid.where("request_id IS NOT NULL").groupBy("request_id").agg(
        F.count_distinct("index_name", "limit").alias("n")).where("n = 1")
    return one.join(other, "request_id", "left_anti").select("request_id")


def numbered_rows(mapping: DataFrame, valid: DataFrame) -> DataFrame:
    """The rows of ``mapping`` that can be a result of at least one request, with
    a number ``row`` that follows (doc_id, file_pos)."""
    asked = F.broadcast(valid.select("index_name", F.lower("lang").alias("lang")).distinct())
    passes = (F.col("mode") == "bare") | lang_filter_cond("lang", "language")
    kept = mapping.alias("m").join(asked.alias("a"), (F.col("m.index_name") == F.col("a.index_name")) & passes, "left_semi")
    return (kept.where("doc_id IS NOT NULL").orderBy("doc_id", "file_pos")
            .withColumn("row", F.monotonically_increasing_id()).checkpoint(eager=True))


def asked_terms(valid: DataFrame, clauses: DataFrame, index: SearchIndex, max_rows: int) -> tuple[DataFrame, bool]:
    """(index_name, term, df, term_no) of the clauses' terms that the indexes
    which are asked hold, and whether they may be broadcast."""
    asked = clauses.select(F.col("text").alias("term")).distinct().checkpoint(eager=True)
    names = F.broadcast(valid.select("index_name").distinct())
    small = asked.count() * names.count() <= max_rows
    known = (index.term_stats.select("index_name", "term", "df").join(names, "index_name", "left_semi")
             .join(F.broadcast(asked) if small else asked, "term")
             .withColumn("id", F.monotonically_increasing_id()).checkpoint(eager=True))
    # Numbers without gaps: an id is its partition (one number each) and its place there.
    part = F.shiftright("id", 33)
    sizes = sorted((r[0], r[1]) for r in known.groupBy(part).agg(F.max("id")).collect())
    ends = np.cumsum([0] + [(last & ((1 << 33) - 1)) + 1 for _, last in sizes]).tolist()
    first = known.sparkSession.createDataFrame([(p, n) for (p, _), n in zip(sizes, ends, strict=False)] or [(0, 0)], "part long, first long")
    no = (F.col("first") + F.col("id").bitwiseAND((1 << 33) - 1)).cast("int")
    known = (known.join(F.broadcast(first), part == F.col("part"))
             .select("index_name", "term", "df", no.alias("term_no")))
    return known, small


def weighted_requests(valid: DataFrame, clauses: DataFrame, terms: DataFrame, small: bool, index: SearchIndex,
                      tasks: int) -> DataFrame:
    """A row per request: index_name, limit, n_must, lang (its rows' languages as
    JSON) and, place by place, the terms' numbers, weights and occurs. A request's
    clauses meet in one of ``tasks`` tasks."""
    cs = F.broadcast(index.corpus_stats.select("index_name", "n_docs"))
    of = valid.groupBy("request_id").agg(
        F.first("index_name").alias("index_name"), F.first("limit").alias("limit"),
        F.to_json(F.sort_array(F.collect_list(F.struct(F.lower("lang").alias("l"))))).alias("lang"))
    w = (clauses.repartition(tasks, "request_id").groupBy("request_id", "occ", F.col("text").alias("term"))
         .agg(F.sum("boost").alias("wsum")).join(of, "request_id")
         .join(F.broadcast(terms) if small else terms, ["index_name", "term"], "left").join(cs, "index_name"))
    held = lambda c: F.when(F.col("term_no").isNotNull(), c)  # noqa: E731  lists leave nulls out
    # a required term that no document holds counts too
    return w.groupBy("request_id", "index_name", "limit", "lang").agg(
        F.count_if(F.col("occ") == 1).cast("int").alias("n_must"), F.collect_list("term_no").alias("terms"),
        F.collect_list(held(F.col("wsum") * idf("df", "n_docs"))).alias("weights"), F.collect_list(held(F.col("occ"))).alias("occs"))


def packed_documents(index: SearchIndex, rows: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """A row per document of ``rows``: its postings of ``terms`` and its result
    rows. On stored postings a document's rows meet in its shard."""
    code = F.when(F.col("mode") == "bare", F.lit("*")).when(F.col("language").isNull(), F.lit("-")) \
        .otherwise(F.concat(F.lit("="), F.lower("language")))
    of = (rows.groupBy("index_name", "doc_id")
          .agg(F.collect_list("row").alias("rows"), F.collect_list(code).alias("langs")))
    held = by_document(index.postings.select("index_name", "term", "doc_id", "tf", "dl"), of.select("index_name", "doc_id"), "left_semi")
    if small:
        held = held.join(F.broadcast(terms), ["index_name", "term"])
    else:
        held = salt_spread(held, TERM_SALTS, "doc_id").join(salt_replicate(terms, TERM_SALTS), ["index_name", "term", "salt"])
    docs = held.groupBy("doc_id", "index_name").agg(
        F.collect_list("term_no").alias("terms"), F.collect_list(F.col("tf").cast("int")).alias("tfs"),
        F.collect_list(F.col("dl").cast("int")).alias("dls"))
    cs = F.broadcast(index.corpus_stats.select("index_name", "avgdl"))
    return by_document(docs, of).join(cs, "index_name")


def block_topk(valid: DataFrame, clauses: DataFrame, index: SearchIndex, rows: DataFrame, max_limit: int,
               max_rows: int = BROADCAST_MAX_ROWS, group_postings: int = GROUP_POSTINGS) -> DataFrame:
    """(request_id, rows): the numbers of a request's best rows of ``rows``
    (``numbered_rows``), best first, at most its limit. ``valid`` and
    ``clauses`` (``said``) hold plain requests only."""
    spark = valid.sparkSession
    cores = spark.sparkContext.defaultParallelism
    terms, small = asked_terms(valid, clauses, index, max_rows)
    docs = packed_documents(index, rows, terms, small).checkpoint(eager=True)
    tasks = max(2 * cores, -(-valid.count() // TASK_REQUESTS))
    asks = weighted_requests(valid, clauses, terms, small, index, tasks).checkpoint(eager=True)
    # A row per index: blocks of its requests, groups of its documents.
    n_asks = {r[0]: r[1] for r in asks.groupBy("index_name").count().collect()}
    n_held = {r[0]: r[1] for r in docs.groupBy("index_name").agg(F.sum(F.size("terms"))).collect()}
    plan, cells = [], 0
    for name in sorted(n_asks.keys() & n_held.keys()):
        n = max(min(-(-n_asks[name] // BATCH), 2 * cores),
                -(-n_asks[name] * max(max_limit, 1) // BLOCK_ROWS))
        plan.append((name, cells, n, max(1, -(-n_held[name] // group_postings))))
        cells += n
    cut = spark.createDataFrame(plan, "index_name string, first int, blocks int, groups int")
    kind = asks.schema["request_id"].dataType.simpleString()
    none = lambda d, *names: [F.lit(None).cast(d.schema[c].dataType).alias(c) for c in names]
    of_ask, of_doc = ["request_id", "limit", "n_must", "lang", "weights", "occs"], ["avgdl", "tfs", "dls", "rows", "langs"]
    left = asks.join(F.broadcast(cut), "index_name").select(
        (F.col("first") + F.pmod(F.xxhash64("request_id"), F.col("blocks"))).cast("int").alias("cell"),
        F.lit(-1).alias("grp"), "terms", *of_ask, *none(docs, *of_doc))
    right = docs.join(F.broadcast(cut), "index_name").withColumn(
        "cell", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("blocks") - 1))).select(
        "cell", F.pmod(F.xxhash64("doc_id"), F.col("groups")).cast("int").alias("grp"), "terms", *none(asks, *of_ask), *of_doc)
    dealt = left.unionByName(right).repartitionById(max(cells, 1), F.col("cell")).sortWithinPartitions("cell", "grp")
    return dealt.mapInArrow(_best, f"request_id {kind}, rows array<bigint>")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and values of a column of lists."""
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), column.flatten()


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (cell, grp), a cell's requests (grp -1) before its
    documents -> the best rows of each request."""
    block, docs, at = _Block(), [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.stack([batch.column("cell").to_numpy(), batch.column("grp").to_numpy()], 1)
        cuts = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = (int(place[a, 0]), int(place[a, 1]))
            if at is not None and here != at and docs:
                block.meet(docs)
                docs = []
            if at is not None and here[0] != at[0]:
                yield from block.results()
                block = _Block()
            at = here
            if here[1] < 0:
                block.add(batch.slice(a, b - a))
            elif block.n:
                docs.append(batch.slice(a, b - a))
    if docs:
        block.meet(docs)
    yield from block.results()


class _Group:
    """Documents with their postings by term, and their result rows."""

    def __init__(self, batches: list[pa.RecordBatch]):
        part = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: part.column(name).combine_chunks()
        sizes, terms = _lists(column("terms"))
        self.n = len(sizes)
        doc = np.repeat(np.arange(self.n), sizes)
        key = terms.to_numpy().astype(np.int64) * self.n + doc
        order = np.argsort(key)
        tf = _lists(column("tfs"))[1].to_numpy().astype(np.float64)
        dl = _lists(column("dls"))[1].to_numpy().astype(np.float64)
        dl *= B
        dl /= np.repeat(column("avgdl").to_numpy(), sizes)
        dl += 1.0 - B
        dl *= K1
        dl += tf
        gain = (tf / dl)[order]
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        # A document that is stored twice gains from each copy.
        self.times = np.diff(np.r_[first, len(key)]) if len(first) < len(key) else None
        if self.times is not None:
            gain, key = np.add.reduceat(gain, first), key[first]
        self.gain, self.doc = gain, (key % self.n).astype(np.int32)
        term = key // self.n
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        self.terms, self.starts = term[starts], np.r_[starts, len(term)]
        held = np.diff(self.starts)
        often = np.flatnonzero(held >= max(DENSE * self.n, 64))
        often = often[np.argsort(-held[often])[:MAX_DENSE]]
        self.line = np.full(len(self.terms) + 1, -1, np.int64)
        self.line[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n))
        for k, t in enumerate(often):
            a, b = self.starts[t], self.starts[t + 1]
            self.matrix[k, self.doc[a:b]] = self.gain[a:b]
        sizes, rows = _lists(column("rows"))
        self.row, self.row_doc = rows.to_numpy(), np.repeat(np.arange(self.n), sizes)
        codes = _lists(column("langs"))[1].dictionary_encode()
        self.code, self.codes = codes.indices.to_numpy(), codes.dictionary.to_pylist()
        self.views: dict[str, tuple] = {}

    def view(self, lang: str) -> tuple[np.ndarray | None, np.ndarray]:
        """Documents (None: each once, in order) and numbers of the rows that
        the languages ``lang`` of a request let pass."""
        if lang not in self.views:
            asked = [x.get("l") for x in json.loads(lang)]
            times = np.array([sum(c == "*" or x is None or c == f"={x}" for x in asked) for c in self.codes])[self.code]
            doc, row = np.repeat(self.row_doc, times), np.repeat(self.row, times)
            whole = len(doc) == self.n and np.array_equal(doc, np.arange(self.n))
            self.views[lang] = (None if whole else doc, row)
        return self.views[lang]

    def list_of(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | int]:
        a, b = self.starts[t], self.starts[t + 1]
        return self.doc[a:b], self.gain[a:b], 1 if self.times is None else self.times[a:b]


class _Block:
    """Requests and the best rows that were found for each so far."""

    def __init__(self):
        self.parts: list[pa.RecordBatch] = []
        self.n, self.found = 0, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append(batch)
        self.n += batch.num_rows

    def _open(self) -> None:
        part = pa.Table.from_batches(self.parts).combine_chunks()
        column = lambda name: part.column(name).combine_chunks()
        self.parts, self.ids = [], column("request_id")
        sizes, terms = _lists(column("terms"))
        self.ends = np.r_[0, np.cumsum(sizes)]
        self.terms = terms.to_numpy()
        self.weights = _lists(column("weights"))[1].to_numpy()
        self.occs = _lists(column("occs"))[1].to_numpy()
        self.limit, self.n_must, self.lang = column("limit").to_numpy(), column("n_must").to_numpy(), column("lang").to_pylist()
        odd = np.r_[0, np.cumsum((self.occs != 0) | ~(self.weights > 0))]
        self.odd = odd[self.ends[1:]] > odd[self.ends[:-1]]
        self.found = [None] * self.n

    def meet(self, docs: list[pa.RecordBatch]) -> None:
        """Scores the block's requests against a group of documents."""
        if not self.n:
            return
        if self.found is None:
            self._open()
        g = _Group(docs)
        at = np.searchsorted(g.terms, self.terms)
        at[at == len(g.terms)] = 0
        at = np.where(g.terms[at] == self.terms, at, len(g.terms)) if len(g.terms) else np.zeros(len(self.terms), np.int64)
        line = g.line[at]
        for a in range(0, self.n, BATCH):
            b = min(a + BATCH, self.n)
            lo, hi = self.ends[a], self.ends[b]
            of = np.repeat(np.arange(b - a), np.diff(self.ends[a:b + 1]))
            dense = line[lo:hi] >= 0
            w = np.zeros((b - a, len(g.matrix)))
            np.add.at(w, (of[dense], line[lo:hi][dense]), self.weights[lo:hi][dense])
            scores = w @ g.matrix
            rest = np.flatnonzero(~dense & (at[lo:hi] < len(g.terms))) + lo
            for k in rest.tolist():
                doc, gain, _ = g.list_of(at[k])
                scores[of[k - lo], doc] += self.weights[k] * gain
            for r in range(a, b):
                s, least = (self._counted(r, g, at), -np.inf) if self.odd[r] else (scores[r - a], 0.0)
                self._keep(r, s, least, g)

    def _counted(self, r: int, g: _Group, at: np.ndarray) -> np.ndarray:
        """Scores of a request with required or prohibited terms, or with weights
        that are not positive; -inf where it has no hit."""
        score, some, must, never = np.zeros(g.n), np.zeros(g.n, np.int64), np.zeros(g.n, np.int64), np.zeros(g.n, np.int64)
        for k in range(self.ends[r], self.ends[r + 1]):
            if at[k] == len(g.terms):
                continue
            doc, gain, times = g.list_of(at[k])
            if self.occs[k] == 2:
                never[doc] += times
                continue
            score[doc] += self.weights[k] * gain
            some[doc] += times
            if self.occs[k] == 1:
                must[doc] += times
        return np.where((never == 0) & (some > 0) & (must == self.n_must[r]), score, -np.inf)

    def _keep(self, r: int, s: np.ndarray, least: float, g: _Group) -> None:
        doc, row = g.view(self.lang[r])
        if doc is not None:
            s = s[doc]
        k, old = int(self.limit[r]), self.found[r]
        if old is not None and len(old[0]) >= k:
            new = np.flatnonzero((s >= old[0][-1] - 1 / UNIT) & (s > least))
        else:
            new = None
            if len(s) > k:
                kth = np.partition(s, len(s) - k)[len(s) - k]
                if kth > least:
                    new = np.flatnonzero(s >= kth - 1 / UNIT)
                    new = new[s[new] > least]
            if new is None:
                new = np.flatnonzero(s > least)
        if not len(new):
            return
        score, row = np.floor(s[new] * UNIT + 0.5) / UNIT, row[new]
        if old is not None:
            score, row = np.r_[old[0], score], np.r_[old[1], row]
        best = np.lexsort((row, -score))[:k]
        self.found[r] = (score[best], row[best])

    def results(self) -> Iterator[pa.RecordBatch]:
        if self.found is None:
            return
        some = [r for r in range(self.n) if self.found[r] is not None]
        for a in range(0, len(some), 4 * BATCH):
            part = some[a:a + 4 * BATCH]
            rows = [self.found[r][1] for r in part]
            ends = np.r_[0, np.cumsum([len(x) for x in rows])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([self.ids.take(pa.array(part)), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))],
                                             ["request_id", "rows"])
