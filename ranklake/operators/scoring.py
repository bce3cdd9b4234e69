"""BM25 evaluation of clause tables, top-k, keyset paging and hit counts.

Plan shape for a table of requests:

1. term clauses -> weights: a small table (request x term) joined to
   ``term_stats`` and the one-row-per-index ``corpus_stats``;
2. weights x postings on (index_name, term): the weights are broadcast when
   a row count proves them small, otherwise both sides are salted so that a
   hot term's posting list is spread over ``TERM_SALTS`` tasks;
3. one aggregation per (request, doc): score sum and the boolean counts
   (MUST all matched, no MUST_NOT, at least one positive clause); on stored
   postings, which are sharded by document, it needs no exchange, otherwise
   the map side combines partial sums before the shuffle;
4. top-k by ``row_number`` with a literal bound, which Catalyst turns into a
   partial ``WindowGroupLimit`` before the shuffle by request, so a request
   that matches a third of the corpus still ships only k rows per task.

Scores are rounded to 1e-6 before ranking so that ties (exact copies in the
corpus) break the same way whatever the summation order; ties go to the
smaller ``doc_id`` (index order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ranklake.config import BROADCAST_MAX_ROWS, FUZZY_MAX_EXPANSIONS, TERM_SALTS
from ranklake.functions.bm25 import idf, quantized_length, tf_norm
from ranklake.functions.text import deletion_signatures, tokens
from ranklake.operators.joins import bounded_broadcast, salt_replicate, salt_spread
from ranklake.operators.postings import SearchIndex
from ranklake.operators.query import MUST, MUST_NOT
from ranklake.operators.ranges import held_ranges

SCORE_DIGITS = 6
_REQ = ["request_id", "index_name", "limit", "n_must"]


def _with_must_count(clauses: DataFrame) -> DataFrame:
    """Adds ``n_must``: distinct MUST keys of the request (a term repeated as
    MUST counts once). Window over the small clause table."""
    key = F.when(F.col("kind") == "term", F.concat(F.lit("t:"), F.col("text"))) \
        .otherwise(F.concat(F.lit("c:"), F.col("clause_no").cast("string")))
    c = clauses.withColumn("key", key)
    w = Window.partitionBy("request_id")
    must_keys = F.collect_set(F.when(F.col("occur") == MUST, F.col("key"))).over(w)
    return c.withColumn("n_must", F.size(must_keys).cast("int"))


def _occ():
    """Occur as a small int: 0 SHOULD, 1 MUST, 2 MUST_NOT."""
    return (F.when(F.col("occur") == MUST, F.lit(1))
            .when(F.col("occur") == MUST_NOT, F.lit(2)).otherwise(F.lit(0))).alias("occ")


def _dl(quantize: bool):
    return quantized_length("dl") if quantize else F.col("dl")


def _postings_join(side: DataFrame, postings: DataFrame, keys: list[str],
                   broadcast_side: bool, salts: int) -> DataFrame:
    if broadcast_side:
        return postings.join(F.broadcast(side), keys, "inner")
    return salt_spread(postings, salts, "doc_id").join(
        salt_replicate(side, salts), keys + ["salt"], "inner").drop("salt")


def _postings_cols(index: SearchIndex, *cols: str) -> DataFrame:
    return index.postings.select("index_name", "term", "doc_id", *cols)


def _ts(index: SearchIndex, *cols: str) -> DataFrame:
    return index.term_stats.select("index_name", "term", *cols)


def _term_hits(c: DataFrame, index: SearchIndex, bcast: bool, salts: int,
               quantize: bool) -> DataFrame:
    g = (c.filter(F.col("kind") == "term")
         .groupBy(*_REQ, "occur", "key", F.col("text").alias("term"))
         .agg(F.sum("boost").alias("wsum")))
    ts = _ts(index, "df")
    cs = F.broadcast(index.corpus_stats.select("index_name", "n_docs", "avgdl"))
    g_side = F.broadcast(g) if bcast else g
    w = (g_side.join(ts, ["index_name", "term"], "inner").join(cs, "index_name", "inner")
         .select(*_REQ, "occur", "key", "term", "avgdl",
                 (F.col("wsum") * idf("df", "n_docs")).alias("weight")))
    p = _postings_cols(index, "tf", "dl")
    h = _postings_join(w, p, ["index_name", "term"], bcast, salts)
    contrib = F.col("weight") * tf_norm("tf", _dl(quantize), "avgdl")
    return h.select("request_id", "doc_id", _occ(), contrib.alias("contrib"))


#: Tokens of a phrase that are looked up at once.
PIECE = 3


def _phrase_hits(c: DataFrame, index: SearchIndex, bcast: bool, salts: int,
                 quantize: bool, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Phrases, cut into pieces of up to ``PIECE`` consecutive tokens: the places
    of the phrases' terms, in a document's order, are equi-joined with the pieces.
    On stored postings that happens inside a document's shard; nothing but the
    phrases themselves leaves it. A phrase stands where all its pieces do. Equal
    phrases of different requests are looked up once."""
    ph = c.filter(F.col("kind") == "phrase")
    form = ["index_name", "text"]
    # Checkpointed, so that the numbers are the same wherever they are read.
    forms = ph.select(*form).distinct().withColumn("fid", F.monotonically_increasing_id()).checkpoint(eager=True)
    bcast = bcast and forms.count() <= max_rows
    small = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    toks = forms.select("index_name", "fid", F.posexplode(tokens("text", index.analyser)).alias("offset", "term"))
    cs = F.broadcast(index.corpus_stats.select("index_name", "n_docs", "avgdl"))
    # A phrase with a term that no document holds is left out.
    whole = Window.partitionBy("fid")
    toks = (_ts(index, "df").join(small(toks), ["index_name", "term"], "right")
            .withColumn("held", F.bool_and(F.col("df").isNotNull()).over(whole)).filter("held")
            .join(cs, "index_name")
            .withColumn("idf_sum", F.sum(idf("df", "n_docs")).over(whole))
            .withColumn("n_terms", F.count(F.lit(1)).over(whole))
            .select("index_name", "fid", "offset", "term", "n_terms", "idf_sum", "avgdl")).checkpoint(eager=True)
    bcast = bcast and toks.count() <= max_rows  # tokens, not phrases
    side = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    ids = (toks.select("index_name", "term").distinct()
           .withColumn("tid", F.monotonically_increasing_id()).checkpoint(eager=True))
    size = F.least("n_terms", F.lit(PIECE))
    none = F.lit(-1).cast("long")  # no term's number
    behind = Window.partitionBy("fid").orderBy("offset")
    pieces = (toks.join(side(ids), ["index_name", "term"])
              .select("fid", "offset", size.alias("size"), (F.col("n_terms") - size + 1).alias("pieces"), F.col("tid").alias("a"),
                      F.coalesce(F.lead("tid", 1).over(behind), none).alias("b"), F.coalesce(F.lead("tid", 2).over(behind), none).alias("c"))
              .filter(F.col("offset") < F.col("pieces")).checkpoint(eager=True))
    sizes = sorted(r["size"] for r in pieces.select("size").distinct().collect())  # at most PIECE
    placed = (_postings_join(ids, _postings_cols(index, "dl", "positions"), ["index_name", "term"], bcast, salts)
              .select("doc_id", "index_name", "dl", "tid", F.explode("positions").alias("pos")))
    order = Window.partitionBy("doc_id", "index_name", "dl").orderBy("pos")

    def after(k: int):
        """The term ``k`` places on; null if it is none of the phrases' terms."""
        return F.when(F.lead("pos", k).over(order) == F.col("pos") + k, F.lead("tid", k).over(order))

    row = placed.select("doc_id", "dl", "pos", F.col("tid").alias("a"), after(1).alias("b"), after(2).alias("c"))
    piece = {1: F.struct("a", none.alias("b"), none.alias("c")), 2: F.struct("a", "b", none.alias("c")), 3: F.struct("a", "b", "c")}
    read = row.select("doc_id", "dl", "pos", F.explode(F.array(*[piece[n] for n in sizes or [1]])).alias("p"))
    hit = _postings_join(pieces.drop("size"), read.select("doc_id", "dl", "pos", "p.*"), ["a", "b", "c"], bcast, salts)
    single = F.col("pieces") == 1
    found = (hit.groupBy("fid", "doc_id", "dl", "pieces", (F.col("pos") - F.col("offset")).alias("start"))
             .agg(F.count(F.lit(1)).alias("n")).filter(single | (F.col("n") == F.col("pieces")))
             .groupBy("fid", "doc_id", "dl").agg(F.sum(F.when(single, F.col("n")).otherwise(1)).alias("freq")))
    scored = (found.join(side(toks.filter(F.col("offset") == 0).select("fid", "idf_sum", "avgdl")), "fid")
              .select("fid", "doc_id", (F.col("idf_sum") * tf_norm("freq", _dl(quantize), "avgdl")).alias("each")))
    hits = scored.join(side(ph.join(small(forms), form)), "fid")
    return hits.select("request_id", "doc_id", _occ(), (F.col("boost") * F.col("each")).alias("contrib"))


def _wildcard_regex(text):
    """Lucene wildcard -> anchored Java regex with literal pieces quoted."""
    quoted = F.regexp_replace(F.regexp_replace(text, r"\*", r"\\E.*\\Q"), r"\?", r"\\E.\\Q")
    return F.concat(F.lit(r"^\Q"), quoted, F.lit(r"\E$"))


def _range_cond(term, lower, upper, inclusive):
    lo_ok = (lower == "") | (lower == "*") | F.when(inclusive, term >= lower).otherwise(term > lower)
    hi_ok = (upper == "") | (upper == "*") | F.when(inclusive, term <= upper).otherwise(term < upper)
    return lo_ok & hi_ok


def _beginning():
    """The text that a clause's terms begin with, where that is all it asks for:
    a prefix, or the regular expression of some letters and ``.*`` (a term
    holds no line break)."""
    return (F.when(F.col("kind") == "prefix", F.col("text"))
            .when((F.col("kind") == "regex") & F.col("text").rlike(r"^[\p{L}\p{N}_]+\.\*$"),
                  F.regexp_replace("text", r"\.\*$", "")))


def _begun_hits(mt: DataFrame, index: SearchIndex, bcast: bool) -> DataFrame:
    """Clauses that ask for a term's beginning: an equi-join of the postings'
    beginnings, of the lengths that are asked for, with the distinct beginnings.
    A document holds many terms of one beginning and is listed once, in its
    shard, before the clauses are joined."""
    side = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    asked = mt.withColumn("begin", _beginning()).filter(F.col("begin") != "")
    forms = asked.select("index_name", "begin").distinct()
    lengths = forms.select("index_name", F.length("begin").alias("n")).distinct()
    places = (_postings_cols(index).join(side(lengths), "index_name")
              .select("index_name", "doc_id", F.expr("substring(term, 1, n)").alias("begin")))
    docs = places.join(side(forms), ["index_name", "begin"], "left_semi").distinct()
    return docs.join(side(asked), ["index_name", "begin"]).select(*_CLAUSE_HIT)


def _range_hits(mt: DataFrame, index: SearchIndex, bcast: bool, max_rows: int) -> DataFrame:
    """Range clauses: every document's terms are placed among the bounds of its
    index's distinct ranges once (``operators.ranges``). Ranges that are too many
    to be sent to the tasks are tried one by one, each up to the first term that
    lies in it."""
    side = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    form = ["index_name", "text", "upper", "inclusive"]
    asked = mt.filter(F.col("kind") == "range")
    # Checkpointed, so that the numbers are the same wherever they are read.
    forms = asked.select(*form).distinct().withColumn("form", F.monotonically_increasing_id()).checkpoint(eager=True)
    docs = (_postings_cols(index).join(F.broadcast(forms.select("index_name").distinct()), "index_name", "left_semi")
            .groupBy("doc_id", "index_name").agg(F.collect_list("term").alias("terms")))
    if bcast and forms.count() <= max_rows:
        ranges = [tuple(r) for r in forms.collect()]
        found = docs.mapInArrow(held_ranges(ranges), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, form long")
        return found.join(F.broadcast(forms), "form").join(side(asked), form).select(*_CLAUSE_HIT)
    held = F.exists("terms", lambda t: _range_cond(t, F.col("text"), F.col("upper"), F.col("inclusive")))
    found = docs.join(side(forms), "index_name").filter(held).select("doc_id", *form)
    return found.join(side(asked), form).select(*_CLAUSE_HIT)


_CLAUSE_HIT = ["request_id", "clause_no", "occur", "doc_id", "boost"]


def _pattern_hits(c: DataFrame, index: SearchIndex, bcast: bool, salts: int,
                  max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """prefix / wildcard / regex / range: a constant score ``boost`` per (clause,
    doc). What begins with some text or lies in a range can be a large part of
    the dictionary; such clauses are looked up in the documents
    (``_begun_hits``, ``_range_hits``). The others filter the dictionary (the
    clause side is small and broadcast), and their terms' postings are read."""
    # Read by every part: parsed once.
    every = c.filter(F.col("kind").isin("prefix", "wildcard", "regex", "range")).checkpoint(eager=True)
    mt = every.filter(F.col("kind").isin("wildcard", "regex") & _beginning().isNull())
    ts = _ts(index)
    term = F.col("term")
    cond = (F.when(F.col("kind") == "wildcard", F.regexp_like(term, _wildcard_regex(F.col("text"))))
            .otherwise(F.regexp_like(term, F.concat(F.lit("^(?:"), F.col("text"), F.lit(")$")))))
    # Equal clauses of different requests meet the dictionary once, and those
    # that fix a term's first character only the terms that begin with it; a
    # wildcard without ``*`` those of its length. A pattern is compiled for every
    # term that it is tried on, so the last character is compared before.
    # The clause side is broadcast behind the clause-table size check; above
    # it the join shuffles and AQE's skew handling splits an index's terms.
    first = (F.when(F.col("kind") == "wildcard", F.substring("text", 1, 1))
             .when((F.col("kind") == "regex") & F.col("text").rlike(r"^[\p{L}\p{N}_](?![*?{])[^|]*$"),
                   F.substring("text", 1, 1)))
    form = ["index_name", "kind", "text"]
    exact = (F.col("kind") == "wildcard") & ~F.col("text").contains("*")
    forms = mt.select(*form, first.alias("first"), F.when(exact, F.length("text")).alias("size")).distinct()
    side = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    last = F.substring("text", -1, 1)
    cond = F.when((F.col("kind") == "wildcard") & ~last.isin("*", "?") & (F.substring("term", -1, 1) != last), F.lit(False)).otherwise(cond)
    dictionary = ts.withColumns({"first": F.substring("term", 1, 1), "size": F.length("term")})
    known = F.col("first").isNotNull()
    begun = dictionary.drop("size").join(side(forms.filter(known & F.col("size").isNull()).drop("size")), ["index_name", "first"])
    sized = dictionary.join(side(forms.filter(known & F.col("size").isNotNull())), ["index_name", "first", "size"])
    free = ts.join(side(forms.filter(~known).drop("first", "size")), "index_name")
    exp = begun.drop("first").unionByName(sized.drop("first", "size")).unionByName(free).filter(cond)
    # What the dictionary makes of the clauses is bounded by the dictionary
    # only: its own rows are counted before it is broadcast.
    small = bcast
    if bcast:
        exp = exp.checkpoint(eager=True)
        small = exp.count() <= max_rows
    found = _postings_join(exp, _postings_cols(index), ["index_name", "term"], small, salts)
    # A document is listed once a form before the requests' clauses are joined.
    docs = found.select("doc_id", *form).distinct()
    hits = (_begun_hits(every, index, bcast).unionByName(_range_hits(every, index, bcast, max_rows))
            .unionByName(docs.join(side(mt), form).select(*_CLAUSE_HIT)))
    # Each clause comes from one of the three, once a document, unless requests
    # share an id and so clauses their key.
    key = ["request_id", "clause_no", "occur"]
    if not every.groupBy(*key).count().filter(F.col("count") > 1).isEmpty():
        hits = hits.groupBy(*key, "doc_id").agg(F.max("boost").alias("boost"))
    return hits.select("request_id", "doc_id", _occ(), F.col("boost").alias("contrib"))


def _fuzzy_hits(c: DataFrame, index: SearchIndex, bcast: bool, salts: int,
                quantize: bool, max_expansions: int, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``term~n``: dictionary terms within n edits (Levenshtein; a
    transposition counts two), similarity ``1 - ed / min(len)``, the best
    ``max_expansions`` by (similarity desc, term), each scored by BM25 with
    the clause's highest df (blended statistics) times its similarity."""
    fz = c.filter((F.col("kind") == "fuzzy") & (F.length("text") > 0))
    cs = F.broadcast(index.corpus_stats.select("index_name", "n_docs", "avgdl"))
    # Threshold 2 (the largest edit distance a fuzzy term admits) lets the
    # distance computation stop early; -1 means "more than 2".
    ed = F.levenshtein(F.col("term"), F.col("text"), 2)
    # Equal clauses of different requests meet the dictionary once, and only
    # the terms that share a deletion signature: an equi-join, then verified.
    form = ["index_name", "text", "max_edits"]
    side = (lambda x: F.broadcast(x)) if bcast else (lambda x: x)
    sigs = F.when(F.col("max_edits") > 1, deletion_signatures("text", 2)).when(
        F.col("max_edits") == 1, deletion_signatures("text", 1)).otherwise(deletion_signatures("text", 0))
    forms = fz.select(*form).distinct().select(*form, F.explode(sigs).alias("sig")).checkpoint(eager=True)
    met = F.broadcast(forms) if bcast and forms.count() <= max_rows else forms
    # Stored, so that the windows and the joins behind are planned by themselves.
    near = (index.by_signature().join(met, ["index_name", "sig"], "inner")
            .filter(F.abs(F.length("term") - F.length("text")) <= F.col("max_edits"))
            .select(*form, "term", "df").distinct()
            .withColumn("ed", ed)
            .filter((F.col("ed") >= 0) & (F.col("ed") <= F.col("max_edits")))
            .withColumn("sim", 1.0 - F.try_divide(F.col("ed"), F.least(F.length("term"), F.length("text"))))
            .filter(F.col("sim") > 0).select(*form, "term", "df", "sim").checkpoint(eager=True))
    wr = Window.partitionBy(*form).orderBy(F.col("sim").desc(), F.col("term"))
    top = near.withColumn("r", F.row_number().over(wr)).filter(F.col("r") <= max_expansions)
    top = top.withColumn("df_blend", F.max("df").over(Window.partitionBy(*form))).select(*form, "term", "sim", "df_blend")
    # Scores add up, so what a request's clauses ask of one term is one weight;
    # only of required clauses each must be met.
    must = F.col("occur") == MUST
    exp = (top.join(side(fz), form, "inner").join(cs, "index_name", "inner")
           .groupBy("request_id", "index_name", "occur", F.when(must, F.col("clause_no")).alias("clause_no"), "term", "avgdl")
           .agg(F.sum(F.col("boost") * F.col("sim") * idf("df_blend", "n_docs")).alias("weight")).checkpoint(eager=True))
    # Up to max_expansions rows for a clause: counted before they are broadcast.
    bcast = bcast and exp.count() <= max_rows
    p = _postings_cols(index, "tf", "dl")

    def gains(asked: DataFrame) -> DataFrame:
        contrib = F.col("weight") * tf_norm("tf", _dl(quantize), "avgdl")
        return _postings_join(asked, p, ["index_name", "term"], bcast, salts).withColumn("contrib", contrib)

    out = ["request_id", "doc_id", _occ(), "contrib"]
    hits = gains(exp.filter(~must)).select(*out)
    if exp.filter(must).isEmpty():
        return hits
    return hits.unionByName(gains(exp.filter(must)).groupBy("request_id", "clause_no", "occur", "doc_id")
                            .agg(F.sum("contrib").alias("contrib")).select(*out))


def evaluate(clauses: DataFrame, index: SearchIndex, quantize: bool = False,
             kinds: set[str] | None = None, max_rows: int = BROADCAST_MAX_ROWS,
             salts: int = TERM_SALTS,
             max_expansions: int = FUZZY_MAX_EXPANSIONS,
             n_clauses: int | None = None) -> DataFrame:
    """clauses -> scores(request_id, index_name, limit, doc_id, score).

    ``kinds`` lists the clause kinds present (default: all); naming only the
    ones used keeps the plan small. ``n_clauses``, when the caller knows a
    bound on the clause rows, saves the counting job."""
    c = _with_must_count(clauses)
    kinds = kinds or {"term", "phrase", "prefix", "wildcard", "regex", "range", "fuzzy"}
    if kinds - {"term"}:  # read many times: parsed once
        c = c.checkpoint(eager=True)
    if n_clauses is None:
        _, bcast = bounded_broadcast(c.select("request_id"), max_rows)
    else:
        bcast = n_clauses <= max_rows
    parts = []
    if "term" in kinds:
        parts.append(_term_hits(c, index, bcast, salts, quantize))
    if "phrase" in kinds:
        parts.append(_phrase_hits(c, index, bcast, salts, quantize, max_rows))
    if kinds & {"prefix", "wildcard", "regex", "range"}:
        parts.append(_pattern_hits(c, index, bcast, salts, max_rows))
    if "fuzzy" in kinds:
        parts.append(_fuzzy_hits(c, index, bcast, salts, quantize, max_expansions, max_rows))
    hits = parts[0]
    for p_ in parts[1:]:
        hits = hits.unionByName(p_)
    # Hits carry only (request, doc, occ, contrib): the aggregation key is
    # (request_id, doc_id) and request-level columns are joined back from
    # the small request table afterwards.
    pos = F.col("occ") != 2
    agg = (hits.groupBy("request_id", "doc_id")
           .agg(F.sum(F.when(pos, F.col("contrib"))).alias("score"),
                F.count_if(F.col("occ") == 1).alias("m"),
                F.count_if(F.col("occ") == 2).alias("x"),
                F.count_if(pos).alias("s")))
    req = c.select(*_REQ).distinct()
    req = F.broadcast(req) if bcast else req
    return (agg.filter((F.col("x") == 0) & (F.col("s") > 0)).join(req, "request_id", "inner")
            .filter(F.col("m") == F.col("n_must"))
            .select("request_id", "index_name", "limit", "doc_id",
                    F.round("score", SCORE_DIGITS).alias("score")))


def bm25_search(requests: DataFrame, index: SearchIndex, quantize: bool = False,
                **kw) -> DataFrame:
    """Plain text ``q`` (default OR) -> scores for every request."""
    from ranklake.operators.query import plain_clauses
    return evaluate(plain_clauses(requests, index.analyser), index, quantize=quantize, kinds={"term"}, **kw)


def request_bounds(requests: DataFrame) -> tuple[int, int]:
    """(number of requests, largest limit): one small aggregate."""
    row = requests.agg(F.count(F.lit(1)).alias("n"), F.max("limit").alias("m")).first()
    return int(row["n"] or 0), int(row["m"] or 0)


def topk_hits(scores: DataFrame, max_limit: int, extra_order: list | None = None,
              limit_col: str = "limit") -> DataFrame:
    """Best ``limit`` rows per request by (score desc, doc_id[, extra]).

    ``max_limit`` (the largest limit of the request table) is the literal
    bound that lets Catalyst plan a partial top-k before the shuffle; the
    per-request ``limit`` column then cuts each request exactly."""
    order = [F.col("score").desc(), F.col("doc_id")] + list(extra_order or [])
    w = Window.partitionBy("request_id").orderBy(*order)
    bound = max(int(max_limit), 1)
    return (scores.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= bound)
            .filter(F.col("rank") <= F.col(limit_col)))


def search_after(scores: DataFrame, cursors: DataFrame, max_limit: int,
                 n_cursors: int | None = None,
                 max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Keyset continuation: cursors(request_id, after_score, after_doc_id);
    hits strictly after the cursor in (score desc, doc_id asc) order, then
    the next ``limit``. Requests without a cursor start at the top. The
    cursor table (one row per request) is broadcast when ``n_cursors``
    proves it small; otherwise AQE picks the join at run time."""
    side = F.broadcast(cursors) if n_cursors is not None and n_cursors <= max_rows else cursors
    c = scores.join(side, "request_id", "left")
    after = (F.col("after_score").isNull()
             | (F.col("score") < F.col("after_score"))
             | ((F.col("score") == F.col("after_score")) & (F.col("doc_id") > F.col("after_doc_id"))))
    return topk_hits(c.filter(after).drop("after_score", "after_doc_id"), max_limit)


def total_hits(scores: DataFrame) -> DataFrame:
    """Exact number of matching documents per request."""
    return scores.groupBy("request_id").agg(F.count(F.lit(1)).cast("long").alias("total_hits"))


def global_rank(scores: DataFrame, extra_order: list | None = None) -> DataFrame:
    """Full ranking of every request's hits without gathering a request in
    one task: a range-partitioned global sort (sampling splits a hot request
    over many tasks), per-partition counts, and a prefix sum over the small
    (request, partition) count table give each row its rank."""
    order = [F.col("request_id"), F.col("score").desc(), F.col("doc_id")] + list(extra_order or [])
    # The numbered rows are read twice (counts and join back): a reliable
    # checkpoint in the shared folder fixes partition ids and row ids once.
    s = (scores.orderBy(*order)
         .withColumn("_part", F.spark_partition_id())
         .withColumn("_mid", F.monotonically_increasing_id())
         .checkpoint(eager=True))
    counts = s.groupBy("request_id", "_part").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    wo = Window.partitionBy("request_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_off", F.coalesce(F.sum("_n").over(wo), F.lit(0)))
    return (s.join(offsets.select("request_id", "_part", "_off", "_first"),
                   ["request_id", "_part"], "inner")
            .withColumn("rank", (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_part", "_mid", "_off", "_first"))


def hit_pages(scores: DataFrame, page_size_col: str = "limit",
              max_pages: int | None = None, max_limit: int | None = None) -> DataFrame:
    """Pages of ``limit`` hits: page = floor((rank - 1) / limit) + 1.

    With ``max_pages`` (and the largest limit) only the first pages are
    ranked, through the bounded top-k; without it every hit gets its page
    through ``global_rank``."""
    if max_pages is not None:
        ranked = topk_hits(scores.withColumn("_cap", F.col(page_size_col) * max_pages),
                           int(max_pages) * int(max_limit or 1), limit_col="_cap").drop("_cap")
    else:
        ranked = global_rank(scores)
    return ranked.withColumn(
        "page", (F.floor((F.col("rank") - 1) / F.col(page_size_col)) + 1).cast("long"))
