"""Deterministic inputs derived from the given tables (see FIXTURES.md).

The reference ships no data. Its inputs (two metadata schemas, an index per
name, a request table, vectors, chat messages) are derived here from
``documents``, ``pages``, ``benchmark``, ``embeddings`` and
``conversations`` with plain DataFrame expressions, so every derived table
grows with the given ones. Each derivation has an SQL twin in
``ranklake.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.config import IMAGE_PREFIX, TOKEN_PATTERN
from ranklake.sources.tables import read_table

# Fixed values of the fixture (FIXTURES.md §2).
INDEX_UUID = "demo_a"
INDEX_URL = "demo_b"
INDEX_MISSING = "nowhere"
REQUEST_LANGS = [None, "en", "DE", "fr", "Es"]
REQUEST_RANKINGS = [None, "asc", "DESC", "other"]
REQUEST_LIMITS = [None, 1, 3, 10, 20, 0]
PAGE_DOC_PATTERN = "/(en|de|fr|es)/([0-9]+)"
HOST_PATTERN = r"^(.*)[.]([^.]+)[.]([^.]+)$"
TITLE_PATTERN = "<title>(.*?)</title>"
BASE_EPOCH_SECONDS = 1672531200  # 2023-01-01T00:00:00Z


def _pick(key, values):
    """values[key % len(values)] as a CASE expression."""
    n = len(values)
    expr = None
    for i, v in enumerate(values):
        cond = F.pmod(key, F.lit(n)) == i
        lit = F.lit(v)
        expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
    return expr


def pages_with_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    doc = F.regexp_extract("url", PAGE_DOC_PATTERN, 2)
    return pages.withColumn("doc_id", F.when(doc != "", doc).cast("bigint"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two indexes over the same documents: ``demo_a`` keyed by UUID (the
    doc id as text), ``demo_b`` keyed by URL (lowest page of the document,
    final slash flipped when page_id % 4 = 0; a placeholder without page)."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    first_page = (pages_with_doc(spark, sf_dir)
                  .groupBy("doc_id")
                  .agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("p"))
                  .select("doc_id", F.col("p.page_id").alias("page_id"),
                          F.col("p.url").alias("url")))
    flipped = F.when(F.col("url").endswith("/"),
                     F.col("url").substr(F.lit(1), F.length("url") - 1)) \
        .otherwise(F.concat("url", F.lit("/")))
    url_key = F.when(F.col("page_id").isNull(),
                     F.concat(F.lit("http://none.example/"), F.col("doc_id").cast("string"))) \
        .when(F.pmod("page_id", F.lit(4)) == 0, flipped).otherwise(F.col("url"))
    uuid_docs = docs.select(F.lit(INDEX_UUID).alias("index_name"), "doc_id",
                            F.col("doc_id").cast("string").alias("doc_key"), "text")
    url_docs = (docs.join(first_page, "doc_id", "left")
                .select(F.lit(INDEX_URL).alias("index_name"), "doc_id",
                        url_key.alias("doc_key"), "text"))
    return uuid_docs.unionByName(url_docs)


def _page_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("plain_text"), F.col("lang").alias("language"))
    return (pages_with_doc(spark, sf_dir).join(docs, "doc_id", "inner")
            .withColumn("title", F.regexp_extract("html", TITLE_PATTERN, 1)))


def metadata_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema A (even page_id): record_id, url (sometimes in <...>), title,
    plain_text, language, warc_date as text (sometimes unparsable)."""
    p = _page_docs(spark, sf_dir).filter(F.pmod("page_id", F.lit(2)) == 0)
    date_txt = F.date_format(
        F.timestamp_seconds(F.lit(BASE_EPOCH_SECONDS) + F.col("doc_id") * 3600),
        "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return p.select(
        F.col("doc_id").cast("string").alias("record_id"),
        F.when(F.pmod("page_id", F.lit(3)) == 0, F.concat(F.lit("<"), "url", F.lit(">")))
        .otherwise(F.col("url")).alias("url"),
        "title", "plain_text", "language",
        F.when(F.pmod("doc_id", F.lit(17)) == 0, F.lit("not-a-date"))
        .otherwise(date_txt).alias("warc_date"),
        F.col("page_id").alias("file_pos"))


def metadata_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema B (odd page_id): id, URL split in parts, warc_date as micros."""
    p = _page_docs(spark, sf_dir).filter(F.pmod("page_id", F.lit(2)) == 1)
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    return p.select(
        F.col("doc_id").cast("string").alias("id"),
        F.regexp_extract("url", r"^([a-z]+)://", 1).alias("url_scheme"),
        F.regexp_extract(host, HOST_PATTERN, 1).alias("url_subdomain"),
        F.regexp_extract(host, HOST_PATTERN, 2).alias("url_domain"),
        F.regexp_extract(host, HOST_PATTERN, 3).alias("url_suffix"),
        F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1).alias("url_path"),
        F.regexp_extract("url", r"[?]([^#]*)", 1).alias("url_query"),
        F.regexp_extract("url", r"#(.*)$", 1).alias("url_fragment"),
        "title", "plain_text", "language",
        ((F.lit(BASE_EPOCH_SECONDS) + F.col("doc_id") * 3600) * 1000000)
        .cast("bigint").alias("warc_date"),
        F.col("page_id").alias("file_pos"))


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per benchmark item: all tokens of its passage as ``q``, the
    other parameters cycling through the fixed lists (nulls included)."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id", "text")
    item = F.col("item_id")
    q = F.array_join(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0), " ")
    index = (F.when(F.pmod(item, F.lit(13)) == 12, F.lit(INDEX_MISSING))
             .when(F.pmod(item, F.lit(2)) == 0, F.lit(INDEX_UUID))
             .otherwise(F.lit(INDEX_URL)))
    return b.select(
        item.alias("request_id"), q.alias("q"), index.alias("index"),
        _pick(item, REQUEST_LANGS).cast("string").alias("lang"),
        _pick(item, REQUEST_RANKINGS).cast("string").alias("ranking"),
        _pick(item, REQUEST_LIMITS).cast("int").alias("limit"))


def message_id():
    """A message's key: its conversation and turn."""
    return F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, qvec): vector ``vec_id = item_id % (number of vectors)``."""
    b = read_table(spark, sf_dir, "benchmark").select("item_id")
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vec = e.agg(F.count(F.lit(1))).scalar()
    return (b.withColumn("vec_id", F.pmod("item_id", n_vec)).join(e, "vec_id", "inner")
            .select(F.col("item_id").alias("request_id"), F.col("embedding").alias("qvec")))


def doc_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dvec): vector ``vec_id = doc_id % (number of vectors)``; the
    vector count is a scalar subquery, not a driver value."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n_vec = e.agg(F.count(F.lit(1))).scalar()
    return (docs.withColumn("vec_id", F.pmod("doc_id", n_vec))
            .join(e, "vec_id", "inner")
            .select("doc_id", F.col("embedding").alias("dvec")))


def table_embedder(spark: SparkSession, sf_dir: str):
    """Embedder backed by the ``embeddings`` table: text -> the vector
    ``vec_id = length(text) % (number of vectors)``. Stands in for a model
    (a ``mapInPandas`` embedder has the same shape: texts in, vectors out)."""
    e = read_table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    n_vec = e.agg(F.count(F.lit(1))).scalar()

    def embed(texts: DataFrame) -> DataFrame:
        return (texts.withColumn("vec_id", F.pmod(F.length("text"), n_vec))
                .join(e, "vec_id", "inner").select("text", "vec_id", "vec"))
    return embed


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as chat messages. The opening user message of every
    fifth conversation is sent as a JPEG data URL of its text, of the next
    one as a PNG data URL (which the router treats as text)."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    # Unchunked base64 whatever the session's chunking setting.
    b64 = F.regexp_replace(F.base64(F.encode("text", "UTF-8")), "[\r\n]", "")
    first_user = (F.col("role") == "user") & (F.col("turn") == 0)
    message = (F.when(first_user & (F.pmod("conv_id", F.lit(5)) == 0),
                      F.concat(F.lit(IMAGE_PREFIX), b64))
               .when(first_user & (F.pmod("conv_id", F.lit(5)) == 1),
                     F.concat(F.lit("data:image/png;base64,"), b64))
               .otherwise(F.col("text")))
    return c.select(
        message_id().alias("message_id"),
        "conv_id", "turn", "role",
        F.concat(F.col("role"), F.lit("_"), F.col("conv_id").cast("string")).alias("username"),
        message.alias("message"))


def chat_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages as JSON text lines ``{message, username, conv_id, ...}``."""
    m = chat_messages(spark, sf_dir)
    return m.select(F.to_json(F.struct("message", "username", "conv_id", "turn",
                                       "role", "message_id")).alias("value"))


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, caption) for image messages: stands in for the caption
    model; all tokens of the message's text."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return (c.filter((F.col("role") == "user") & (F.col("turn") == 0)
                     & (F.pmod("conv_id", F.lit(5)) == 0))
            .select(message_id().alias("message_id"),
                    F.lower(F.array_join(F.regexp_extract_all("text", F.lit(TOKEN_PATTERN), 0), " "))
                    .alias("caption")))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(message_id, answer): stands in for the language model; the answer to
    a user message is the assistant text of the next turn."""
    c = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    u = c.filter(F.col("role") == "user").select("conv_id", "turn")
    return u.join(a, ["conv_id", "turn"], "inner").select(
        message_id().alias("message_id"), "answer")
