"""Registered queries: one per operator of the inventory, each reading the
given tables (or what Spark derives from them) at ``sf_dir``.

Every callable takes (spark, sf_dir) and returns a DataFrame whose column
names and types equal the DuckDB twin in ``ranklake.plans.oracle``. Array
outputs are rendered as text and floating values rounded to 1e-6 so the
two engines can be compared value by value.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.functions.text import text_snippet, word_count
from ranklake.functions.url import url_schema_a, url_schema_b
from ranklake.functions.vectors import cosine_similarity, dot_product
from ranklake.operators import chain, chat
from ranklake.operators.enrich import (enrich_hits, filtered_topk, lang_filter_cond,
                                       metadata_by_id, url_join, uuid_join)
from ranklake.operators.postings import SearchIndex, index_registry, shards_for
from ranklake.operators.query import query_terms
from ranklake.operators.requests import (requests_with_defaults, retriever_requests, valid_requests,
                                         validate_requests)
from ranklake.operators.scoring import (bm25_search, hit_pages, request_bounds,
                                        search_after, topk_hits, total_hits)
from ranklake.plans.search import results_json, search
from ranklake.sources import fixtures as fx
from ranklake.sources.tables import read_table

DEFAULT_INDEX = fx.INDEX_UUID


class Ctx:
    """Lazily derived inputs of one scale factor."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf = spark, sf_dir

    @cached_property
    def corpus(self) -> DataFrame:
        return fx.corpus(self.spark, self.sf)

    @cached_property
    def store(self):
        from ranklake.plans.store import store_for
        return store_for(self.spark, self.sf)

    @cached_property
    def index(self) -> SearchIndex:
        return self.store.index

    @cached_property
    def meta(self) -> DataFrame:
        return self.store.meta

    @cached_property
    def reqs(self) -> DataFrame:
        return requests_with_defaults(fx.requests(self.spark, self.sf), DEFAULT_INDEX)

    @cached_property
    def validated(self) -> DataFrame:
        return validate_requests(self.reqs, index_registry(self.index))

    @cached_property
    def valid(self) -> DataFrame:
        return valid_requests(self.validated)

    @cached_property
    def bounds(self) -> tuple[int, int]:
        return request_bounds(self.valid)

    @cached_property
    def scores(self) -> DataFrame:
        return bm25_search(self.valid, self.index)

    @cached_property
    def mapping(self) -> DataFrame:
        return self.store.mapping

    @cached_property
    def search(self):
        return search(fx.requests(self.spark, self.sf), self.index, self.meta, DEFAULT_INDEX,
                      mapping=self.mapping, records=self.store.records)

    @cached_property
    def retrieved(self) -> DataFrame:
        """Retriever documents: the requests with the retriever's defaults, the
        result snippet chunked (page_content), ``source`` = url, the other
        result fields as metadata."""
        sent = retriever_requests(fx.requests(self.spark, self.sf), DEFAULT_INDEX)
        r = search(sent, self.index, self.meta, DEFAULT_INDEX, mapping=self.mapping,
                   records=self.store.records).results
        chunks = chain.explode_chunks(
            r, "textSnippet", ["request_id", "rank", "url", "id", "title", "language",
                               "warcDate", "wordCount"])
        return chunks.select("request_id", "rank", "chunk_no", F.col("chunk").alias("page_content"),
                             F.col("url").alias("source"), "url", "id", "title", "language",
                             "warcDate", "wordCount")


def _long(*names):
    return [F.col(n).cast("long").alias(n) for n in names]


def q_metadata_scan(spark, sf):
    """The two schema groups written as the metadata files of a directory, one
    per index (a folder of sorted parts each), and read back by the directory
    scan. ``file_pos`` is a record's place in its index, which is written in the
    fixture's order."""
    from ranklake.session import scratch_path
    from ranklake.sources.metadata import scan_metadata_dir, write_metadata
    root = scratch_path(spark, "metadata-dir")
    groups = ((fx.INDEX_UUID, fx.metadata_a(spark, sf)), (fx.INDEX_URL, fx.metadata_b(spark, sf)))
    for name, rows in groups:
        write_metadata(rows, f"{root}/{name}.parquet", spark.sparkContext.defaultParallelism)
    return scan_metadata_dir(spark, root)


def q_metadata_by_id(spark, sf):
    return metadata_by_id(Ctx(spark, sf).meta.drop("plain_text"))


def q_index_registry(spark, sf):
    return index_registry(Ctx(spark, sf).index)


def q_build_postings(spark, sf):
    """The postings built from the corpus in this query (not the stored copy)."""
    p = SearchIndex.build(fx.corpus(spark, sf)).postings
    return p.select("index_name", "term", "doc_id", "tf", "dl",
                    F.array_join(F.transform("positions", lambda x: x.cast("string")), ",")
                    .alias("positions"))


def q_corpus_stats(spark, sf):
    c = Ctx(spark, sf).index.corpus_stats
    return c.select("index_name", "n_docs", "sum_dl", F.round("avgdl", 6).alias("avgdl"))


def q_term_stats(spark, sf):
    return Ctx(spark, sf).index.term_stats.select("index_name", "term", "df")


def q_requests_with_defaults(spark, sf):
    return Ctx(spark, sf).reqs.select("request_id", "q", "index_name", "lang", "ranking", "limit")


def q_validate_requests(spark, sf):
    return Ctx(spark, sf).validated.select("request_id", "index_name", "limit", "status", "error")


def q_request_errors(spark, sf):
    """Good and bad requests in one table: by request_id modulo 8 an open
    quote, a leading wildcard, a bad regular expression, a limit that is no
    number, a phrase with slop or an operator without its clause. The good
    ones get their hits, the others their status."""
    from ranklake.operators.query import clauses_from_q
    from ranklake.operators.scoring import evaluate
    c = Ctx(spark, sf)
    k, q = F.pmod("request_id", F.lit(8)), F.col("q")
    bad = (F.when(k == 1, F.concat(F.lit('"'), q)).when(k == 2, F.concat(F.lit("*"), q))
           .when(k == 3, F.concat(q, F.lit(" /[/"))).when(k == 5, F.concat(q, F.lit(' "a b"~2')))
           .when(k == 6, F.concat(F.lit("AND "), q)).otherwise(q))
    limit = F.when(k == 4, F.lit("abc")).otherwise(F.col("limit").cast("string"))
    raw = fx.requests(spark, sf).withColumns({"q": bad, "limit": limit})
    checked = validate_requests(requests_with_defaults(raw, DEFAULT_INDEX), index_registry(c.index))
    hits = total_hits(evaluate(clauses_from_q(valid_requests(checked)), c.index, kinds={"term"}))
    return checked.join(hits, "request_id", "left").select(
        "request_id", "status", "error", F.coalesce("total_hits", F.lit(0)).cast("long").alias("total_hits"))


def q_query_terms(spark, sf):
    return query_terms(Ctx(spark, sf).valid)


def q_match_any(spark, sf):
    return Ctx(spark, sf).scores.select("request_id", "index_name", "doc_id")


def q_bm25_score(spark, sf):
    return Ctx(spark, sf).scores.select("request_id", "index_name", "doc_id", "score")


def q_topk_hits(spark, sf):
    c = Ctx(spark, sf)
    t = topk_hits(c.scores, c.bounds[1])
    return t.select("request_id", *_long("rank"), "doc_id", "score")


def q_total_hits(spark, sf):
    return total_hits(Ctx(spark, sf).scores)


def q_search_after(spark, sf):
    """Cursor = the best hit of each request; the next ``limit`` hits."""
    c = Ctx(spark, sf)
    first = topk_hits(c.scores.withColumn("_one", F.lit(1)), 1, limit_col="_one")
    cursors = first.select("request_id", F.col("score").alias("after_score"),
                           F.col("doc_id").alias("after_doc_id"))
    t = search_after(c.scores, cursors, c.bounds[1], n_cursors=c.bounds[0])
    return t.select("request_id", *_long("rank"), "doc_id", "score")


def q_hit_pages(spark, sf):
    return hit_pages(Ctx(spark, sf).scores).select("request_id", "doc_id", *_long("rank", "page"))


def q_filtered_topk(spark, sf):
    c = Ctx(spark, sf)
    n, m = c.bounds
    t = filtered_topk(c.scores, c.valid, c.mapping, m, n)
    return t.select("request_id", *_long("rank"), "index_name", "doc_id", "file_pos")


def q_search_urls_only(spark, sf):
    c = Ctx(spark, sf)
    out = search(fx.requests(spark, sf), c.index, None, DEFAULT_INDEX)
    return out.results.select("request_id", *_long("rank"), "url")


def q_build_url(spark, sf):
    p = fx.pages_with_doc(spark, sf)
    wrapped = F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("<"), "url", F.lit(">"))) \
        .otherwise(F.col("url"))
    b = fx.metadata_b(spark, sf).select("file_pos", url_schema_b(
        "url_scheme", "url_subdomain", "url_domain", "url_suffix", "url_path", "url_query",
        "url_fragment").alias("url_b"))
    a = p.select("page_id", url_schema_a(wrapped).alias("url_a"))
    return a.join(b, a.page_id == b.file_pos, "left").select("page_id", "url_a", "url_b")


def _docs_of(c: Ctx, name: str) -> DataFrame:
    return c.index.doc_stats.filter(F.col("index_name") == name).select("index_name", "doc_id", "doc_key")


def q_url_join(spark, sf):
    c = Ctx(spark, sf)
    j = url_join(_docs_of(c, fx.INDEX_URL), c.meta.select(
        "index_name", F.col("url").alias("meta_url"), "file_pos"), url_col="meta_url")
    return j.select("doc_id", "doc_key", "file_pos", "meta_url")


def q_uuid_join(spark, sf):
    c = Ctx(spark, sf)
    j = uuid_join(_docs_of(c, fx.INDEX_UUID), metadata_by_id(c.meta.select("index_name", "id", "file_pos")))
    return j.select("doc_id", "doc_key", "file_pos", "id")


def q_enrich_hits(spark, sf):
    c = Ctx(spark, sf)
    e = enrich_hits(c.index.doc_stats.select("index_name", "doc_id", "doc_key"),
                    c.meta.select("index_name", "id", "url", "language", "file_pos"))
    return e.select("index_name", "doc_id", "file_pos", "mode", "out_url")


def q_lang_filter(spark, sf):
    c = Ctx(spark, sf)
    j = (c.scores.join(c.valid.select("request_id", "lang"), "request_id")
         .join(c.mapping, ["index_name", "doc_id"]))
    return j.filter(lang_filter_cond()).select("request_id", "doc_id", "file_pos")


def q_clean_fields(spark, sf):
    from ranklake.functions.text import java_trim
    m = Ctx(spark, sf).meta
    return m.select("index_name", "file_pos", java_trim("title").alias("title"),
                    java_trim("language").alias("language"))


def q_text_snippet(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", text_snippet("text").alias("snippet"))


def q_word_count(spark, sf):
    d = read_table(spark, sf, "documents")
    return d.select("doc_id", word_count("text").alias("word_count"))


def q_warc_date(spark, sf):
    return Ctx(spark, sf).meta.select("index_name", "file_pos", "warc_date")


def q_result_rows(spark, sf):
    from ranklake.operators.enrich import result_fields
    m = Ctx(spark, sf).meta
    return m.select("index_name", "file_pos", *result_fields(m, url_col="url"))


def q_rerank_word_count(spark, sf):
    r = Ctx(spark, sf).search.results
    return r.select("request_id", *_long("rank"), "url", "id", "wordCount")


def q_results_json(spark, sf):
    out = Ctx(spark, sf).search
    return results_json(out.results, out.valid)


def q_retrieve(spark, sf):
    r = Ctx(spark, sf).retrieved
    return r.select("request_id", *_long("rank", "chunk_no"), "page_content", "source", "id",
                    "title", "language", "warcDate", "wordCount")


def q_chunk_text(spark, sf):
    from ranklake.operators.partitioning import spread
    d = spread(read_table(spark, sf, "documents").select("doc_id", "text"))
    return chain.explode_chunks(d, "text", ["doc_id"]).select("doc_id", *_long("chunk_no"), "chunk")


def q_stuff_context(spark, sf):
    s = chain.stuff_context(Ctx(spark, sf).retrieved, text_col="page_content")
    return s.select("request_id", *_long("n_chunks"), "context")


def q_answer_sources(spark, sf):
    s = chain.answer_sources(Ctx(spark, sf).retrieved)
    return s.select("request_id", F.array_join("sources", " ").alias("sources"),
                    F.array_join("shown", " ").alias("shown"))


def q_reference_links(spark, sf):
    s = chain.answer_sources(Ctx(spark, sf).retrieved)
    return s.select("request_id", chain.reference_links("shown").alias("html"))


def _conversations(spark, sf):
    return read_table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def q_memory_window(spark, sf):
    m = chain.memory_window(_conversations(spark, sf))
    return m.select("conv_id", "turn", "role")


def q_memory_reset(spark, sf):
    c = _conversations(spark, sf).withColumn("is_reset", F.col("role") == "system")
    m = chain.memory_reset(c)
    return m.select("conv_id", "turn", "role")


def _pairs(c: Ctx) -> DataFrame:
    """(request_id, rank, doc_id, qvec, dvec) over the search results."""
    r = c.search.results.select("request_id", "rank", F.col("id").cast("long").alias("doc_id"))
    return (r.join(fx.query_vectors(c.spark, c.sf), "request_id", "inner")
            .join(fx.doc_vectors(c.spark, c.sf), "doc_id", "inner"))


def q_dot_product(spark, sf):
    p = _pairs(Ctx(spark, sf))
    return p.select("request_id", "doc_id",
                    F.round(dot_product("qvec", "dvec").cast("double"), 6).alias("dot"))


def q_cosine_similarity(spark, sf):
    p = _pairs(Ctx(spark, sf))
    return p.select("request_id", "doc_id",
                    F.round(cosine_similarity("qvec", "dvec"), 6).alias("cosine"))


def q_semantic_rerank(spark, sf):
    from ranklake.operators.rerank import semantic_rerank
    p = _pairs(Ctx(spark, sf)).withColumn("sim", cosine_similarity("qvec", "dvec"))
    r = semantic_rerank(p, "sim", order="desc")
    return r.select("request_id", *_long("rank"), "doc_id", F.round("sim", 6).alias("cosine"))


def q_embed_distinct(spark, sf):
    """Query texts and result snippets embedded once per distinct text."""
    from ranklake.functions.vectors import squared_norm
    from ranklake.operators.rerank import embed_distinct
    c = Ctx(spark, sf)
    texts = c.valid.select("request_id", F.lit(0).alias("rank"), F.col("q").alias("text")) \
        .unionByName(c.search.results.select("request_id", "rank", F.col("textSnippet").alias("text")))
    e = embed_distinct(texts, fx.table_embedder(spark, sf))
    return e.select("request_id", *_long("rank", "vec_id"),
                    F.round(F.sqrt(squared_norm("vec")), 6).alias("norm"))


def _text_shape(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: code points and blanks of a text."""
    return [[float(len(t)), float(t.count(" "))] for t in texts]


def q_embed_memo(spark, sf):
    """A memo filled in two runs: the accepted requests' texts first, then the
    same texts with the documents; the second run embeds only what is new."""
    from ranklake.operators.memo import EmbeddingMemo
    from ranklake.session import scratch_path
    memo = EmbeddingMemo(spark, scratch_path(spark, "memo"))
    asked = Ctx(spark, sf).valid.select(F.lit("request").alias("kind"), F.col("request_id").alias("id"), F.col("q").alias("text"))
    memo.embed(asked, _text_shape)
    docs = read_table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    out = memo.embed(asked.unionByName(docs), _text_shape)
    return out.select("kind", "id", *[F.col("vec")[i].cast("long").alias(n) for i, n in enumerate(("n_chars", "n_blanks"))], "error")


def _messages(spark, sf):
    return fx.chat_messages(spark, sf)


def q_chat_source(spark, sf):
    m = chat.parse_messages(fx.chat_json(spark, sf))
    return m.select("message_id", "conv_id", "turn", "role", "username", "message")


def q_message_router(spark, sf):
    return chat.message_router(_messages(spark, sf)).select("message_id", "route")


def q_image_payload(spark, sf):
    r = chat.message_router(_messages(spark, sf)).filter(F.col("route") == "image")
    p = chat.image_payload(r)
    return p.select("message_id", F.octet_length("payload").cast("long").alias("n_bytes"),
                    F.decode("payload", "UTF-8").alias("text"))


def q_caption_query(spark, sf):
    r = chat.message_router(_messages(spark, sf)).filter(F.col("role") == "user")
    q = chat.caption_query(r, fx.captions(spark, sf))
    return q.select("message_id", "route", "query")


REGISTRY = {
    "metadata_scan": q_metadata_scan,
    "metadata_by_id": q_metadata_by_id,
    "index_registry": q_index_registry,
    "build_postings": q_build_postings,
    "corpus_stats": q_corpus_stats,
    "term_stats": q_term_stats,
    "requests_with_defaults": q_requests_with_defaults,
    "validate_requests": q_validate_requests,
    "request_errors": q_request_errors,
    "query_terms": q_query_terms,
    "match_any": q_match_any,
    "bm25_score": q_bm25_score,
    "topk_hits": q_topk_hits,
    "total_hits": q_total_hits,
    "search_after": q_search_after,
    "hit_pages": q_hit_pages,
    "filtered_topk": q_filtered_topk,
    "search_urls_only": q_search_urls_only,
    "build_url": q_build_url,
    "url_join": q_url_join,
    "uuid_join": q_uuid_join,
    "enrich_hits": q_enrich_hits,
    "lang_filter": q_lang_filter,
    "clean_fields": q_clean_fields,
    "text_snippet": q_text_snippet,
    "word_count": q_word_count,
    "warc_date": q_warc_date,
    "result_rows": q_result_rows,
    "rerank_word_count": q_rerank_word_count,
    "results_json": q_results_json,
    "retrieve": q_retrieve,
    "chunk_text": q_chunk_text,
    "stuff_context": q_stuff_context,
    "answer_sources": q_answer_sources,
    "reference_links": q_reference_links,
    "memory_window": q_memory_window,
    "memory_reset": q_memory_reset,
    "dot_product": q_dot_product,
    "cosine_similarity": q_cosine_similarity,
    "semantic_rerank": q_semantic_rerank,
    "embed_distinct": q_embed_distinct,
    "embed_memo": q_embed_memo,
    "chat_source": q_chat_source,
    "message_router": q_message_router,
    "image_payload": q_image_payload,
    "caption_query": q_caption_query,
}


# ---- query forms -----------------------------------------------------------

def _each(form):
    """``q`` with one item for every token of the passage: ``form`` gets the
    token and its place (from 1)."""
    return F.array_join(F.transform("toks", lambda t, i: form(t, i + 1)), " ")


def _form_requests(c: Ctx, q) -> DataFrame:
    """Accepted requests with ``q`` rebuilt from the benchmark item's
    lower-cased tokens by ``q`` (a column over ``toks``)."""
    from ranklake.functions.text import tokens
    toks = read_table(c.spark, c.sf, "benchmark").select(
        F.col("item_id").alias("request_id"), tokens("text").alias("toks"))
    return c.valid.drop("q").join(toks, "request_id", "inner").withColumn("q", q).drop("toks")


def _form_scores(spark, sf, q, kinds, quantize=False):
    from ranklake.operators.query import clauses_from_q
    from ranklake.operators.scoring import evaluate
    c = Ctx(spark, sf)
    s = evaluate(clauses_from_q(_form_requests(c, q)), c.index, quantize=quantize, kinds=kinds)
    return s.select("request_id", "doc_id", "score")


def bool_form():
    """+first second third -fourth fifth AND sixth seventh ... NOT last."""
    n = F.size("toks")
    return _each(lambda t, i: F.when(i == 1, F.concat(F.lit("+"), t)).when(i == 4, F.concat(F.lit("-"), t))
                 .when((i == 6) & (n >= 6), F.concat(F.lit("AND "), t))
                 .when((i == n) & (n > 6), F.concat(F.lit("NOT "), t)).otherwise(t))


def phrase_form():
    """A phrase for every three consecutive tokens."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size("toks"), F.lit(1))), lambda i: i <= F.size("toks") - 2)
    return F.array_join(F.transform(starts, lambda i: F.concat(
        F.lit('"'), F.array_join(F.slice("toks", i, F.lit(3)), " "), F.lit('"'))), " ")


def fuzzy_form():
    """Every token fuzzy: two edits, one edit, or a similarity of 0.8."""
    return _each(lambda t, i: F.concat(t, F.when(i % 3 == 1, F.lit("~")).when(i % 3 == 2, F.lit("~1")).otherwise(F.lit("~0.8"))))


def q_match_bool(spark, sf):
    return _form_scores(spark, sf, bool_form(), {"term"})


def q_match_phrase(spark, sf):
    return _form_scores(spark, sf, phrase_form(), {"phrase"})


def pattern_form():
    """Every token in one of four forms by its place: prefix, wildcard,
    regular expression, range up to the next token (open behind the last)."""
    def form(t, i):
        nxt = F.coalesce(F.try_element_at("toks", (i + 1).cast("int")), F.lit("*"))
        return (F.when(i % 4 == 1, F.concat(t.substr(F.lit(1), F.lit(3)), F.lit("*")))
                .when(i % 4 == 2, F.concat(t.substr(F.lit(1), F.lit(1)), F.lit("?"), t.substr(F.lit(3), F.length(t))))
                .when(i % 4 == 3, F.concat(F.lit("/"), t.substr(F.lit(1), F.lit(2)), F.lit(".*/")))
                .otherwise(F.concat(F.lit("["), t, F.lit(" TO "), nxt, F.lit("]"))))
    return _each(form)


def q_match_pattern(spark, sf):
    return _form_scores(spark, sf, pattern_form(), {"prefix", "wildcard", "regex", "range"})


def q_match_fuzzy(spark, sf):
    return _form_scores(spark, sf, fuzzy_form(), {"fuzzy"})


def q_boosted_terms(spark, sf):
    """Every token, boosted by 2, 1 or 0.5."""
    q = _each(lambda t, i: F.concat(t, F.when(i % 3 == 1, F.lit("^2")).when(i % 3 == 2, F.lit("")).otherwise(F.lit("^0.5"))))
    return _form_scores(spark, sf, q, {"term"})


def q_bm25_quantized(spark, sf):
    c = Ctx(spark, sf)
    s = bm25_search(c.valid, c.index, quantize=True)
    return s.select("request_id", "index_name", "doc_id", "score")


REGISTRY.update({
    "match_bool": q_match_bool,
    "match_phrase": q_match_phrase,
    "match_pattern": q_match_pattern,
    "match_fuzzy": q_match_fuzzy,
    "boosted_terms": q_boosted_terms,
    "bm25_quantized": q_bm25_quantized,
})


#: Micro-batches of the streamed memory query.
MEMORY_BATCHES = 4

# ---- streaming ---------------------------------------------------------------

def _chat_cfg():
    from ranklake.streaming.chat_stream import ChatConfig
    return ChatConfig(index=fx.INDEX_UUID)


def _chat_files(spark, sf) -> str:
    """The chat messages as JSON lines in a fresh folder of the shared
    checkpoint dir (the stream's source)."""
    from ranklake.session import scratch_path
    path = scratch_path(spark, "chat-in")
    fx.chat_json(spark, sf).write.mode("overwrite").text(path)
    return path


def q_stream_transcript(spark, sf):
    from ranklake.streaming.chat_stream import transcript_batch
    c = Ctx(spark, sf)
    t = transcript_batch(fx.chat_messages(spark, sf), c.index, c.meta, _chat_cfg(),
                         fx.captions(spark, sf), fx.answers(spark, sf), c.mapping,
                         c.store.records)
    return t.select("message_id", *_long("seq"), "username", "text")


def q_stream_search(spark, sf):
    from ranklake.session import scratch_path
    from ranklake.streaming.chat_stream import chat_source, stream_search
    c = Ctx(spark, sf)
    sink = scratch_path(spark, "chat-out")
    q = stream_search(chat_source(spark, _chat_files(spark, sf)), c.index, c.meta, _chat_cfg(),
                      fx.captions(spark, sf), fx.answers(spark, sf), sink, mapping=c.mapping,
                      records=c.store.records)
    q.awaitTermination()
    return spark.read.parquet(sink).select("message_id", *_long("seq"), "username", "text")


def _file_count(spark, path: str) -> int:
    return len(spark.read.text(path).inputFiles())


def q_stream_memory_reset(spark, sf):
    """Final streamed memory with resets (k = 5; ``system`` turns reset). As in
    ``stream_memory`` turns come late and twice, over several micro-batches, so
    resets come before and after what they forget."""
    from pyspark.sql import Window
    from ranklake.session import scratch_path
    from ranklake.streaming.chat_stream import chat_source
    from ranklake.streaming.memory import stream_memory_reset, use_rocksdb
    path, sink = scratch_path(spark, "reset-in"), scratch_path(spark, "reset-out")
    lines = fx.chat_json(spark, sf)
    n = MEMORY_BATCHES
    for k in range(n):
        lines.filter((F.pmod(F.xxhash64("value"), F.lit(n)) == k)
                     | (F.pmod(F.xxhash64("value"), F.lit(7 * n)) == (k - 1) % n)).write.mode("append").text(path)
    per = max(1, -(-_file_count(spark, path) // n))
    use_rocksdb(spark)
    stream = chat_source(spark, path, max_files_per_trigger=per).withColumn("is_reset", F.col("role") == "system")
    q = (stream_memory_reset(stream).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "reset-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    last = F.max("emit").over(Window.partitionBy("conv_id"))
    return (spark.read.parquet(sink).withColumn("_last", last)
            .filter((F.col("emit") == F.col("_last")) & F.col("turn").isNotNull())
            .select("conv_id", "turn", "role"))


def q_stream_memory(spark, sf):
    """Final streamed memory per conversation (k = 5). The messages come in
    several micro-batches, dealt over files by a hash so that turns arrive out
    of order, and every seventh message comes twice."""
    from pyspark.sql import Window
    from ranklake.session import scratch_path
    from ranklake.streaming.chat_stream import chat_source, stream_memory
    path, sink = scratch_path(spark, "memory-in"), scratch_path(spark, "memory-out")
    lines = fx.chat_json(spark, sf)
    again = lines.filter(F.pmod(F.xxhash64("value"), F.lit(7)) == 0)
    n = MEMORY_BATCHES
    for k in range(n):
        first = lines.filter(F.pmod(F.xxhash64("value"), F.lit(n)) == k)
        late = again.filter(F.pmod(F.xxhash64("value"), F.lit(n)) == (k - 1) % n)
        first.unionByName(late).write.mode("append").text(path)
    per = max(1, -(-_file_count(spark, path) // n))
    mem = stream_memory(chat_source(spark, path, max_files_per_trigger=per), idle_ms=None)
    q = (mem.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", scratch_path(spark, "memory-ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.read.parquet(sink)
    last = F.max("emit").over(Window.partitionBy("conv_id"))
    return (out.withColumn("_last", last).filter(F.col("emit") == F.col("_last"))
            .select("conv_id", "turn", "role"))


REGISTRY.update({
    "stream_transcript": q_stream_transcript,
    "stream_search": q_stream_search,
    "stream_memory": q_stream_memory,
    "stream_memory_reset": q_stream_memory_reset,
})


def q_bm25_uax29(spark, sf):
    """BM25 of the passages on the indexes built with the second analyser."""
    from ranklake.plans.store import documents_size
    from ranklake.session import scratch_path
    c = Ctx(spark, sf)
    index = SearchIndex.build(c.corpus, analyser="uax29_like").save(
        scratch_path(spark, "uax29"), shards_for(spark, documents_size(spark, sf)))
    valid = valid_requests(validate_requests(c.reqs, index_registry(index)))
    return bm25_search(valid, index).select("request_id", "index_name", "doc_id", "score")


REGISTRY["bm25_uax29"] = q_bm25_uax29
