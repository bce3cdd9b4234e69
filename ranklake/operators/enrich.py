"""Metadata enrichment: canonical metadata, the two lookups (by id and by
slash-tolerant URL), the language filter, the filter-first top-k and the
result projection.

Canonical metadata columns::

    index_name, id, url, title, plain_text, language, warc_date, file_pos

``url`` is the rebuilt record URL and ``warc_date`` the output text, both
cheap per-row expressions; the expensive fields over ``plain_text``
(snippet, word count) are only computed for the rows that survive top-k.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklake.config import BROADCAST_MAX_ROWS
from ranklake.functions.dates import warc_date_schema_a, warc_date_schema_b
from ranklake.functions.text import java_trim, text_snippet, word_count
from ranklake.functions.url import url_match_keys, url_schema_a, url_schema_b
from ranklake.operators.scoring import topk_hits

META_COLUMNS = ["index_name", "id", "url", "title", "plain_text", "language",
                "warc_date", "file_pos"]
# file_pos of the single empty record row of an index without metadata.
BARE_POS = -1
RESULT_COLUMNS = ["url", "id", "title", "textSnippet", "language", "warcDate", "wordCount"]


def canonical_schema_a(df: DataFrame, index_name=None) -> DataFrame:
    """Schema A (``record_id`` present) -> canonical columns."""
    name = F.col("index_name") if index_name is None else F.lit(index_name)
    return df.select(
        name.alias("index_name"), F.col("record_id").alias("id"),
        url_schema_a("url").alias("url"), "title", "plain_text", "language",
        warc_date_schema_a("warc_date").alias("warc_date"),
        F.col("file_pos").cast("long").alias("file_pos"))


def canonical_schema_b(df: DataFrame, index_name=None) -> DataFrame:
    """Schema B (URL in parts, long ``warc_date``) -> canonical columns."""
    name = F.col("index_name") if index_name is None else F.lit(index_name)
    return df.select(
        name.alias("index_name"), F.col("id"),
        url_schema_b("url_scheme", "url_subdomain", "url_domain", "url_suffix",
                     "url_path", "url_query", "url_fragment").alias("url"),
        "title", "plain_text", "language",
        warc_date_schema_b("warc_date").alias("warc_date"),
        F.col("file_pos").cast("long").alias("file_pos"))


def metadata_by_id(meta: DataFrame) -> DataFrame:
    """id -> record; of duplicate ids the last record in file order wins.

    ``max_by`` in a hash aggregation combines duplicates on the map side, so
    a hot id never lands whole in one task."""
    cols = [c for c in meta.columns if c not in ("index_name", "id")]
    return (meta.groupBy("index_name", "id")
            .agg(F.max_by(F.struct(*cols), "file_pos").alias("r"))
            .select("index_name", "id", *[F.col(f"r.{c}").alias(c) for c in cols]))


def url_join(hits: DataFrame, meta: DataFrame, key_col: str = "doc_key",
             url_col: str = "url") -> DataFrame:
    """Pairs (hit, record) with ``key = url or key = url + '/' or url = key + '/'``.

    The metadata side is exploded to its (at most three) matching keys and
    equi-joined: a sort-merge or broadcast join instead of the cartesian
    product the OR condition would plan."""
    keyed = meta.select(*[c for c in meta.columns if c != "index_name"],
                        F.col("index_name").alias("_m_index"),
                        F.explode(url_match_keys(url_col)).alias("_mkey"))
    return (hits.join(keyed, (F.col("index_name") == F.col("_m_index"))
                      & (F.col(key_col) == F.col("_mkey")), "inner")
            .drop("_m_index", "_mkey"))


def uuid_join(hits: DataFrame, meta_by_id: DataFrame, key_col: str = "doc_key") -> DataFrame:
    """Hit key -> the record with that id (deduplicated metadata)."""
    m = meta_by_id.withColumnRenamed("index_name", "_m_index")
    return (hits.join(m, (F.col("index_name") == F.col("_m_index"))
                      & (F.col(key_col) == F.col("id")), "inner")
            .drop("_m_index"))


def enrich_hits(hits: DataFrame, meta: DataFrame, key_col: str = "doc_key") -> DataFrame:
    """Per hit: a key starting with ``http`` joins by URL (all records of
    the file, the hit keeps its own URL), any other key joins by id (last
    record wins, URL rebuilt from the record). Output adds the canonical
    metadata columns, ``out_url`` and ``mode``."""
    is_url = F.col(key_col).startswith("http")
    by_url = (url_join(hits.filter(is_url), meta.withColumnRenamed("url", "meta_url"), key_col,
                       "meta_url")
              .withColumn("out_url", F.col(key_col)).withColumn("mode", F.lit("url")))
    by_id = (uuid_join(hits.filter(~is_url), metadata_by_id(meta), key_col)
             .withColumn("meta_url", F.col("url")).drop("url")
             .withColumn("out_url", F.col("meta_url")).withColumn("mode", F.lit("uuid")))
    return by_url.unionByName(by_id)


def lang_filter_cond(lang_col: str = "lang", language_col: str = "language"):
    """No filter, or case-insensitive equality; a record without language
    does not pass a filter."""
    lang, language = F.col(lang_col), F.col(language_col)
    return lang.isNull() | (language.isNotNull() & (F.lower(language) == F.lower(lang)))


def lang_filter(df: DataFrame, lang_col: str = "lang", language_col: str = "language") -> DataFrame:
    return df.filter(lang_filter_cond(lang_col, language_col))


def result_fields(df: DataFrame, url_col: str = "out_url") -> list:
    """The seven output fields of one result row."""
    return [F.col(url_col).alias("url"), F.col("id"),
            java_trim("title").alias("title"),
            text_snippet("plain_text").alias("textSnippet"),
            java_trim("language").alias("language"),
            F.col("warc_date").alias("warcDate"),
            word_count("plain_text").alias("wordCount")]


RECORD_COLUMNS = ["id", "title", "textSnippet", "language", "warcDate", "wordCount"]


def result_records(meta: DataFrame) -> DataFrame:
    """The query-independent result fields of every metadata record,
    (index_name, file_pos, id, title, textSnippet, language, warcDate,
    wordCount): computed once per record (at index build, or for the
    records a top-k needs), never once per result row."""
    fields = result_fields(meta, url_col="url")[1:]
    return meta.select("index_name", "file_pos", *fields)


def doc_meta(doc_stats: DataFrame, meta: DataFrame | None) -> DataFrame:
    """Query-independent mapping of indexed documents to result rows:
    (index_name, doc_id, file_pos, language, mode, out_url). Indexes with
    metadata map through the URL or id lookup (``mode`` url / uuid);
    indexes without metadata get one ``bare`` row per document (URL only,
    no language filter, no re-rank). Built once per index and storable."""
    docs = doc_stats.select("index_name", "doc_id", "doc_key")
    bare = docs
    parts = []
    if meta is not None:
        names = F.broadcast(meta.select("index_name").distinct())
        mapped = enrich_hits(docs.join(names, "index_name", "left_semi"),
                             meta.select("index_name", "id", "url", "language", "file_pos"))
        parts.append(mapped.select("index_name", "doc_id", "file_pos", "language", "mode",
                                   "out_url"))
        bare = docs.join(names, "index_name", "left_anti")
    parts.append(bare.select("index_name", "doc_id", F.lit(BARE_POS).cast("long").alias("file_pos"),
                             F.lit(None).cast("string").alias("language"),
                             F.lit("bare").alias("mode"), F.col("doc_key").alias("out_url")))
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out


def by_document(rows: DataFrame, mapping: DataFrame, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``mapping`` on (index_name, doc_id). The document
    alone is the join key and the index a condition behind it, so that postings
    and mapping stored in the same shards by document meet without a shuffle;
    a shard's part of the mapping is hashed, the rows are not sorted."""
    m = mapping.withColumnsRenamed({"index_name": "_m_index", "doc_id": "_m_doc"}).hint("shuffle_hash")
    same = (rows["index_name"] >= F.col("_m_index")) & (rows["index_name"] <= F.col("_m_index"))
    return rows.join(m, (rows["doc_id"] == F.col("_m_doc")) & same, how).drop("_m_index", "_m_doc")


def askable(mapping: DataFrame, requests: DataFrame) -> DataFrame:
    """The (index_name, doc_id) of ``mapping`` that pass the language filter of
    at least one of ``requests`` (index_name, lang): no other can be a result."""
    asked = F.broadcast(requests.select("index_name", F.lower("lang").alias("lang")).distinct())
    m = mapping.select("index_name", "doc_id", "mode", "language").alias("m")
    passes = (F.col("mode") == "bare") | lang_filter_cond("lang", "language")
    return m.join(asked.alias("a"), (F.col("m.index_name") == F.col("a.index_name")) & passes, "left_semi") \
        .select("index_name", "doc_id")


def result_hits(scores: DataFrame, requests: DataFrame, mapping: DataFrame,
                n_requests: int) -> DataFrame:
    """Scores joined to the result rows of their documents that pass the
    request's language filter; ``bare`` rows (index without metadata) pass
    unfiltered. ``requests`` carries (request_id, lang)."""
    langs = requests.select("request_id", "lang")
    if n_requests <= BROADCAST_MAX_ROWS:
        langs = F.broadcast(langs)
    j = by_document(scores.join(langs, "request_id", "inner"), mapping)
    return j.filter((F.col("mode") == "bare") | lang_filter_cond("lang", "language"))


def filtered_topk(scores: DataFrame, requests: DataFrame, mapping: DataFrame,
                  max_limit: int, n_requests: int) -> DataFrame:
    """Fill-to-limit: hits without a result row or failing the request's
    language filter do not use up the limit. Join and filter first, then
    rank by (score desc, doc_id, record file order) and keep ``limit``
    rows per request."""
    return topk_hits(result_hits(scores, requests, mapping, n_requests), max_limit,
                     extra_order=[F.col("file_pos")])
