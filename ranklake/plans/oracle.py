"""DuckDB SQL twins of the registered queries (the correctness oracle).

Each query is a body over named CTEs; ``build`` pulls in the CTEs a body
needs, in dependency order. The SQL restates the semantics independently
(regexes, window functions, list functions); it shares no code with the
Spark side. Output columns and types match the Spark queries in
``ranklake.plans.catalog``.
"""

from __future__ import annotations

TOKEN_RE = r"[\p{L}\p{N}_]+"

# name -> (dependencies, SQL of the CTE body)
CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], sql: str) -> None:
    CTES[name] = (deps, sql)


cte("pages_doc", [], """
SELECT page_id, url, html,
       TRY_CAST(NULLIF(regexp_extract(url, '/(en|de|fr|es)/([0-9]+)', 2), '') AS BIGINT) AS doc_id
FROM pages""")

cte("first_page", ["pages_doc"], """
SELECT doc_id, min(page_id) AS page_id, arg_min(url, page_id) AS url
FROM pages_doc WHERE doc_id IS NOT NULL GROUP BY doc_id""")

cte("corpus", ["first_page"], """
SELECT 'demo_a' AS index_name, doc_id, CAST(doc_id AS VARCHAR) AS doc_key, text FROM documents
UNION ALL
SELECT 'demo_b' AS index_name, d.doc_id,
       CASE WHEN f.page_id IS NULL THEN 'http://none.example/' || CAST(d.doc_id AS VARCHAR)
            WHEN f.page_id % 4 = 0 THEN
                 CASE WHEN suffix(f.url, '/') THEN substr(f.url, 1, length(f.url) - 1)
                      ELSE f.url || '/' END
            ELSE f.url END AS doc_key,
       d.text
FROM documents d LEFT JOIN first_page f ON d.doc_id = f.doc_id""")

cte("tok", ["corpus"], f"""
SELECT index_name, doc_id, len(t) AS dl, unnest(t) AS term, unnest(range(len(t))) AS pos
FROM (SELECT index_name, doc_id, regexp_extract_all(lower(text), '{TOKEN_RE}') AS t FROM corpus)""")

cte("postings", ["tok"], """
SELECT index_name, term, doc_id, CAST(count(*) AS BIGINT) AS tf, CAST(dl AS BIGINT) AS dl,
       list(pos ORDER BY pos) AS positions
FROM tok GROUP BY index_name, term, doc_id, dl""")

cte("doc_len", ["postings"], """
SELECT index_name, doc_id, max(dl) AS dl FROM postings GROUP BY index_name, doc_id""")

cte("doc_stats", ["doc_len", "corpus"], """
SELECT l.index_name, l.doc_id, c.doc_key, l.dl
FROM doc_len l JOIN corpus c ON l.index_name = c.index_name AND l.doc_id = c.doc_id""")

cte("term_stats", ["postings"], """
SELECT index_name, term, CAST(count(*) AS BIGINT) AS df FROM postings GROUP BY index_name, term""")

cte("corpus_stats", ["doc_len"], """
SELECT index_name, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(dl) AS BIGINT) AS sum_dl,
       CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl
FROM doc_len GROUP BY index_name""")

cte("page_docs", ["pages_doc"], """
SELECT p.page_id, p.url, p.html, p.doc_id, d.text AS plain_text, d.lang AS language,
       regexp_extract(p.html, '<title>(.*?)</title>', 1) AS title
FROM pages_doc p JOIN documents d ON p.doc_id = d.doc_id""")

cte("meta_a_raw", ["page_docs"], """
SELECT CAST(doc_id AS VARCHAR) AS record_id,
       CASE WHEN page_id % 3 = 0 THEN '<' || url || '>' ELSE url END AS url,
       title, plain_text, language,
       CASE WHEN doc_id % 17 = 0 THEN 'not-a-date'
            ELSE strftime(make_timestamp((1672531200 + doc_id * 3600) * 1000000),
                          '%Y-%m-%dT%H:%M:%SZ') END AS warc_date,
       page_id AS file_pos
FROM page_docs WHERE page_id % 2 = 0""")

cte("meta_b_raw", ["page_docs"], """
SELECT CAST(doc_id AS VARCHAR) AS id,
       regexp_extract(url, '^([a-z]+)://', 1) AS url_scheme,
       regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(.*)[.]([^.]+)[.]([^.]+)$', 1) AS url_subdomain,
       regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(.*)[.]([^.]+)[.]([^.]+)$', 2) AS url_domain,
       regexp_extract(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1), '^(.*)[.]([^.]+)[.]([^.]+)$', 3) AS url_suffix,
       regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS url_path,
       regexp_extract(url, '[?]([^#]*)', 1) AS url_query,
       regexp_extract(url, '#(.*)$', 1) AS url_fragment,
       title, plain_text, language,
       CAST((1672531200 + doc_id * 3600) * 1000000 AS BIGINT) AS warc_date,
       page_id AS file_pos
FROM page_docs WHERE page_id % 2 = 1""")

URL_A = """CASE WHEN suffix(CASE WHEN prefix(url, '<') THEN substr(url, 2) ELSE url END, '>')
     THEN substr(CASE WHEN prefix(url, '<') THEN substr(url, 2) ELSE url END, 1,
                 length(CASE WHEN prefix(url, '<') THEN substr(url, 2) ELSE url END) - 1)
     ELSE CASE WHEN prefix(url, '<') THEN substr(url, 2) ELSE url END END"""

URL_B = """url_scheme || '://'
  || CASE WHEN url_subdomain IS NOT NULL AND url_subdomain <> '' THEN url_subdomain || '.' ELSE '' END
  || url_domain || '.' || url_suffix
  || CASE WHEN url_path IS NOT NULL AND url_path <> '' THEN url_path ELSE '' END
  || CASE WHEN url_query IS NOT NULL AND url_query <> '' THEN '?' || url_query ELSE '' END
  || CASE WHEN url_fragment IS NOT NULL AND url_fragment <> '' THEN '#' || url_fragment ELSE '' END"""

cte("meta", ["meta_a_raw", "meta_b_raw"], f"""
SELECT 'demo_a' AS index_name, record_id AS id, {URL_A} AS url, title, plain_text, language,
       COALESCE(CAST(epoch_us(try_strptime(warc_date, '%Y-%m-%dT%H:%M:%SZ')) AS VARCHAR), warc_date) AS warc_date,
       CAST(file_pos AS BIGINT) AS file_pos
FROM meta_a_raw
UNION ALL
SELECT 'demo_b' AS index_name, id, {URL_B} AS url, title, plain_text, language,
       CAST(warc_date AS VARCHAR) AS warc_date, CAST(file_pos AS BIGINT) AS file_pos
FROM meta_b_raw""")

cte("meta_by_id", ["meta"], """
SELECT * FROM meta
QUALIFY row_number() OVER (PARTITION BY index_name, id ORDER BY file_pos DESC) = 1""")

cte("url_pairs", ["doc_stats", "meta"], """
SELECT d.index_name, d.doc_id, d.doc_key, m.file_pos, m.language, m.url AS meta_url, m.id
FROM doc_stats d JOIN meta m ON d.index_name = m.index_name
 AND (d.doc_key = m.url OR d.doc_key = m.url || '/' OR m.url = d.doc_key || '/')
WHERE prefix(d.doc_key, 'http')""")

cte("id_pairs", ["doc_stats", "meta_by_id"], """
SELECT d.index_name, d.doc_id, d.doc_key, m.file_pos, m.language, m.url AS meta_url, m.id
FROM doc_stats d JOIN meta_by_id m ON d.index_name = m.index_name AND d.doc_key = m.id
WHERE NOT prefix(d.doc_key, 'http')""")

cte("mapping", ["url_pairs", "id_pairs"], """
SELECT index_name, doc_id, doc_key, file_pos, language, 'url' AS mode, doc_key AS out_url FROM url_pairs
UNION ALL
SELECT index_name, doc_id, doc_key, file_pos, language, 'uuid' AS mode, meta_url AS out_url FROM id_pairs""")

cte("raw_req", [], f"""
SELECT item_id AS request_id,
       array_to_string(regexp_extract_all(text, '{TOKEN_RE}'), ' ') AS q,
       CASE WHEN item_id % 13 = 12 THEN 'nowhere' WHEN item_id % 2 = 0 THEN 'demo_a' ELSE 'demo_b' END AS "index",
       CASE item_id % 5 WHEN 1 THEN 'en' WHEN 2 THEN 'DE' WHEN 3 THEN 'fr' WHEN 4 THEN 'Es' END AS lang,
       CASE item_id % 4 WHEN 1 THEN 'asc' WHEN 2 THEN 'DESC' WHEN 3 THEN 'other' END AS ranking,
       CAST(CASE item_id % 6 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 10 WHEN 4 THEN 20 WHEN 5 THEN 0 END AS INTEGER) AS "limit"
FROM benchmark""")

cte("reqs", ["raw_req"], """
SELECT request_id, q, lang, ranking, COALESCE("index", 'demo_a') AS index_name,
       CAST(COALESCE("limit", 20) AS INTEGER) AS "limit"
FROM raw_req""")

cte("validated", ["reqs", "corpus_stats"], """
SELECT r.*,
  CASE WHEN r.q IS NULL OR trim(r.q) = '' THEN 500 WHEN g.index_name IS NULL THEN 404
       WHEN r."limit" <= 0 THEN 400 ELSE 200 END AS status,
  CASE WHEN r.q IS NULL OR trim(r.q) = '' THEN 'The query could not be parsed'
       WHEN g.index_name IS NULL THEN 'The index could not be found'
       WHEN r."limit" <= 0 THEN 'The limit must be a positive value' END AS error
FROM reqs r LEFT JOIN (SELECT DISTINCT index_name FROM corpus_stats) g ON r.index_name = g.index_name""")

cte("valid", ["validated"], """
SELECT request_id, q, lang, ranking, index_name, "limit" FROM validated WHERE status = 200""")

cte("qt", ["valid"], f"""
SELECT request_id, index_name, "limit", term, CAST(count(*) AS BIGINT) AS qtf
FROM (SELECT request_id, index_name, "limit", unnest(regexp_extract_all(lower(q), '{TOKEN_RE}')) AS term FROM valid)
GROUP BY request_id, index_name, "limit", term""")

BM25_TERM = ("ln(1 + (c.n_docs - t.df + 0.5) / (t.df + 0.5)) "
             "* (p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl)))")

cte("scores", ["qt", "term_stats", "corpus_stats", "postings"], f"""
SELECT q.request_id, q.index_name, q."limit", p.doc_id,
       round(sum(q.qtf * {BM25_TERM}), 6) AS score
FROM qt q
JOIN term_stats t ON q.index_name = t.index_name AND q.term = t.term
JOIN corpus_stats c ON q.index_name = c.index_name
JOIN postings p ON q.index_name = p.index_name AND q.term = p.term
GROUP BY q.request_id, q.index_name, q."limit", p.doc_id""")

# The second analyser without look-around or class intersection: words of
# letters and digits with inner marks, Katakana runs, runs of the scripts
# without spaces, and one token for every ideograph and Hiragana sign.
_JOIN = r"[\p{M}\p{Cf}]*"
_ALPHA = r"[^\P{L}\p{Han}\p{Hiragana}\p{Katakana}\x{30FC}\x{FF70}\p{Thai}\p{Lao}\p{Myanmar}\p{Khmer}]"
_WORD29 = (rf"(?:{_ALPHA}{_JOIN})+(?:[:\x27.\x{{B7}}\x{{2018}}\x{{2019}}\x{{2024}}\x{{2027}}\x{{FE13}}\x{{FE52}}\x{{FE55}}\x{{FF07}}\x{{FF0E}}\x{{FF1A}}]"
           rf"{_JOIN}(?:{_ALPHA}{_JOIN})+)*")
_NUM29 = (rf"(?:\p{{Nd}}{_JOIN})+(?:[,;\x27.\x{{37E}}\x{{589}}\x{{2018}}\x{{2019}}\x{{2024}}\x{{2044}}\x{{FE10}}\x{{FE14}}\x{{FE50}}\x{{FE52}}\x{{FE54}}"
          rf"\x{{FF07}}\x{{FF0C}}\x{{FF0E}}\x{{FF1B}}]{_JOIN}(?:\p{{Nd}}{_JOIN})+)*")
_UNIT29 = rf"(?:(?:{_WORD29}|{_NUM29})+|(?:[\p{{Katakana}}\x{{30FC}}\x{{FF70}}]{_JOIN})+)"
_LINK29 = rf"(?:\p{{Pc}}{_JOIN})"
TOKEN29_RE = (rf"{_LINK29}*{_UNIT29}(?:{_LINK29}+{_UNIT29})*{_LINK29}*"
              rf"|(?:[^\P{{Thai}}\p{{N}}]|[^\P{{Lao}}\p{{N}}]|[^\P{{Myanmar}}\p{{N}}]|[^\P{{Khmer}}\p{{N}}])+|[\p{{Han}}\p{{Hiragana}}]{_JOIN}")

cte("tok29", ["corpus"], f"""
SELECT index_name, doc_id, len(t) AS dl, unnest(t) AS term
FROM (SELECT index_name, doc_id, regexp_extract_all(lower(text), '{TOKEN29_RE}') AS t FROM corpus)""")

cte("postings29", ["tok29"], """
SELECT index_name, term, doc_id, dl, count(*) AS tf FROM tok29 GROUP BY ALL""")

cte("corpus29", ["postings29"], """
SELECT index_name, count(*) AS n_docs, CAST(sum(dl) AS DOUBLE) / count(*) AS avgdl
FROM (SELECT DISTINCT index_name, doc_id, dl FROM postings29) GROUP BY index_name""")

cte("terms29", ["postings29"], """
SELECT index_name, term, count(*) AS df FROM postings29 GROUP BY index_name, term""")

cte("scores29", ["valid", "postings29", "corpus29", "terms29"], f"""
SELECT q.request_id, q.index_name, p.doc_id, round(sum({BM25_TERM}), 6) AS score
FROM (SELECT request_id, index_name, unnest(regexp_extract_all(lower(q), '{TOKEN29_RE}')) AS term FROM valid) q
JOIN terms29 t ON t.index_name = q.index_name AND t.term = q.term
JOIN corpus29 c ON c.index_name = q.index_name
JOIN postings29 p ON p.index_name = q.index_name AND p.term = q.term
GROUP BY q.request_id, q.index_name, p.doc_id""")

cte("topk", ["scores"], """
SELECT * FROM (
  SELECT request_id, index_name, "limit", doc_id, score,
         row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rank
  FROM scores) WHERE rank <= "limit" """)

cte("ftopk", ["scores", "valid", "mapping"], """
SELECT * FROM (
  SELECT s.request_id, s.index_name, s."limit", s.doc_id, s.score, m.file_pos, m.mode, m.out_url,
         row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.doc_id, m.file_pos) AS rank
  FROM scores s JOIN valid v ON s.request_id = v.request_id
  JOIN mapping m ON s.index_name = m.index_name AND s.doc_id = m.doc_id
  WHERE v.lang IS NULL OR (m.language IS NOT NULL AND lower(m.language) = lower(v.lang)))
WHERE rank <= "limit" """)

JAVA_TRIM = "regexp_replace({x}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
SNIPPET = JAVA_TRIM.format(
    x="list_reduce(string_split({t}, chr(10)), lambda a, y: CASE WHEN length(y) > length(a) "
      "THEN y ELSE a END, '')")
WORD_COUNT = ("CAST(CASE WHEN {t} = '' THEN 1 "
              "WHEN regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+$', '') = '' THEN 0 "
              "ELSE len(regexp_split_to_array(regexp_replace({t}, '[ \\t\\n\\x0B\\f\\r]+$', ''), "
              "'[ \\t\\n\\x0B\\f\\r]+')) END AS INTEGER)")


def snippet(t: str) -> str:
    return SNIPPET.replace("{t}", t)


def word_count(t: str) -> str:
    return WORD_COUNT.replace("{t}", t)


def java_trim(x: str) -> str:
    return JAVA_TRIM.replace("{x}", x)


cte("result_rows", ["ftopk", "meta", "valid"], f"""
SELECT f.request_id, f.rank AS rel_rank, f.out_url AS url, m.id, {java_trim('m.title')} AS title,
       {snippet('m.plain_text')} AS "textSnippet", {java_trim('m.language')} AS language,
       m.warc_date AS "warcDate", {word_count('m.plain_text')} AS "wordCount", v.ranking
FROM ftopk f JOIN meta m ON f.index_name = m.index_name AND f.file_pos = m.file_pos
JOIN valid v ON f.request_id = v.request_id""")

cte("results", ["result_rows"], """
SELECT request_id, url, id, title, "textSnippet", language, "warcDate", "wordCount",
       row_number() OVER (PARTITION BY request_id ORDER BY
         CASE lower(ranking) WHEN 'asc' THEN "wordCount" WHEN 'desc' THEN -"wordCount" ELSE 0 END,
         rel_rank) AS rank
FROM result_rows""")

PY_WS = ("[\\s\\x0B\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}"
         "\\x{202f}\\x{205f}\\x{3000}]")

cte("retrieved", ["results"], f"""
SELECT request_id, rank, 0 AS chunk_no,
       regexp_replace("textSnippet", '^{PY_WS}+|{PY_WS}+$', '', 'g') AS page_content,
       url AS source, url, id, title, language, "warcDate", "wordCount"
FROM results
WHERE regexp_replace("textSnippet", '^{PY_WS}+|{PY_WS}+$', '', 'g') <> ''""")


def build(body: str, needs: list[str]) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in needs:
        visit(n)
    if not order:
        return body.strip()
    withs = ",\n".join(f"{n} AS ({CTES[n][1].strip()})" for n in order)
    return f"WITH {withs}\n{body.strip()}"


def _vec_pairs() -> None:
    cte("qvec", [], """
SELECT b.item_id AS request_id, e.embedding AS qvec
FROM benchmark b JOIN embeddings e ON b.item_id % (SELECT count(*) FROM embeddings) = e.vec_id""")
    cte("dvec", [], """
SELECT d.doc_id, e.embedding AS dvec
FROM documents d JOIN embeddings e ON d.doc_id % (SELECT count(*) FROM embeddings) = e.vec_id""")
    cte("pairs", ["results", "qvec", "dvec"], """
SELECT r.request_id, r.rank, CAST(r.id AS BIGINT) AS doc_id, q.qvec, d.dvec
FROM results r JOIN qvec q ON r.request_id = q.request_id
JOIN dvec d ON CAST(r.id AS BIGINT) = d.doc_id""")
    cte("pair_sims", ["pairs"], """
SELECT request_id, rank, doc_id,
  list_reduce(list_transform(list_zip(qvec, dvec), lambda z: CAST(z[1] AS FLOAT) * CAST(z[2] AS FLOAT)),
              lambda s, x: CAST(s + x AS FLOAT), CAST(0 AS FLOAT)) AS dot,
  sqrt(list_reduce(list_transform(qvec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda s, x: s + x, CAST(0 AS DOUBLE)))
  * sqrt(list_reduce(list_transform(dvec, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), lambda s, x: s + x, CAST(0 AS DOUBLE))) AS den
FROM pairs""")


_vec_pairs()

cte("messages", [], """
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id, conv_id, turn, role,
       role || '_' || CAST(conv_id AS VARCHAR) AS username,
       CASE WHEN role = 'user' AND turn = 0 AND conv_id % 5 = 0
              THEN 'data:image/jpeg;base64,' || to_base64(encode(text))
            WHEN role = 'user' AND turn = 0 AND conv_id % 5 = 1
              THEN 'data:image/png;base64,' || to_base64(encode(text))
            ELSE text END AS message
FROM conversations""")

cte("captions", [], f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS message_id,
       lower(array_to_string(regexp_extract_all(text, '{TOKEN_RE}'), ' ')) AS caption
FROM conversations WHERE role = 'user' AND turn = 0 AND conv_id % 5 = 0""")

ROUTE = "CASE WHEN prefix(message, 'data:image/jpeg;base64,') THEN 'image' ELSE 'text' END"

ORACLE: dict[str, tuple[str, list[str]]] = {
    "metadata_scan": ("SELECT index_name, id, url, title, plain_text, language, warc_date, row_number() OVER (PARTITION BY index_name ORDER BY file_pos) - 1 AS file_pos FROM meta", ["meta"]),
    "metadata_by_id": ("SELECT index_name, id, url, title, language, warc_date, file_pos FROM meta_by_id", ["meta_by_id"]),
    "index_registry": ("SELECT DISTINCT index_name FROM corpus_stats", ["corpus_stats"]),
    "build_postings": ("SELECT index_name, term, doc_id, tf, dl, array_to_string(positions, ',') AS positions FROM postings", ["postings"]),
    "corpus_stats": ("SELECT index_name, n_docs, sum_dl, round(avgdl, 6) AS avgdl FROM corpus_stats", ["corpus_stats"]),
    "term_stats": ("SELECT index_name, term, df FROM term_stats", ["term_stats"]),
    "requests_with_defaults": ('SELECT request_id, q, index_name, lang, ranking, "limit" FROM reqs', ["reqs"]),
    "validate_requests": ('SELECT request_id, index_name, "limit", CAST(status AS INTEGER) AS status, error FROM validated', ["validated"]),
    "request_errors": ("""
SELECT v.request_id, CAST(CASE WHEN k IN (1, 2, 3, 4, 5, 6) THEN 500 ELSE v.status END AS INTEGER) AS status,
       CASE WHEN k IN (1, 2, 3, 5, 6) THEN 'The query could not be parsed' WHEN k = 4 THEN 'The limit must be an integer'
            ELSE v.error END AS error,
       CAST(CASE WHEN k IN (0, 7) THEN coalesce(n.hits, 0) ELSE 0 END AS BIGINT) AS total_hits
FROM (SELECT *, request_id % 8 AS k FROM validated) v
LEFT JOIN (SELECT request_id, count(*) AS hits FROM scores GROUP BY request_id) n ON v.request_id = n.request_id""", ["validated", "scores"]),
    "query_terms": ("SELECT request_id, index_name, term, CAST(sum(qtf) AS BIGINT) AS qtf FROM qt GROUP BY request_id, index_name, term", ["qt"]),
    "match_any": ("SELECT request_id, index_name, doc_id FROM scores", ["scores"]),
    "bm25_score": ("SELECT request_id, index_name, doc_id, score FROM scores", ["scores"]),
    "bm25_uax29": ("SELECT request_id, index_name, doc_id, score FROM scores29", ["scores29"]),
    "topk_hits": ("SELECT request_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM topk", ["topk"]),
    "total_hits": ("SELECT request_id, CAST(count(*) AS BIGINT) AS total_hits FROM scores GROUP BY request_id", ["scores"]),
    "search_after": ("""
SELECT request_id, CAST(rank AS BIGINT) AS rank, doc_id, score FROM (
  SELECT s.request_id, s.doc_id, s.score, s."limit",
         row_number() OVER (PARTITION BY s.request_id ORDER BY s.score DESC, s.doc_id) AS rank
  FROM scores s JOIN (SELECT request_id, score AS a_s, doc_id AS a_d FROM topk WHERE rank = 1) c
    ON s.request_id = c.request_id
  WHERE s.score < c.a_s OR (s.score = c.a_s AND s.doc_id > c.a_d))
WHERE rank <= "limit" """, ["scores", "topk"]),
    "hit_pages": ("""
SELECT request_id, doc_id, CAST(rank AS BIGINT) AS rank,
       CAST(floor((rank - 1) / "limit") + 1 AS BIGINT) AS page FROM (
  SELECT request_id, doc_id, "limit",
         row_number() OVER (PARTITION BY request_id ORDER BY score DESC, doc_id) AS rank
  FROM scores)""", ["scores"]),
    "filtered_topk": ("SELECT request_id, CAST(rank AS BIGINT) AS rank, index_name, doc_id, file_pos FROM ftopk", ["ftopk"]),
    "search_urls_only": ("""
SELECT t.request_id, CAST(t.rank AS BIGINT) AS rank, d.doc_key AS url
FROM topk t JOIN doc_stats d ON t.index_name = d.index_name AND t.doc_id = d.doc_id""", ["topk", "doc_stats"]),
    "build_url": (f"""
SELECT p.page_id,
       (SELECT {URL_A} FROM (SELECT CASE WHEN p.page_id % 3 = 0 THEN '<' || p.url || '>' ELSE p.url END AS url)) AS url_a,
       (SELECT {URL_B} FROM meta_b_raw b WHERE b.file_pos = p.page_id) AS url_b
FROM pages_doc p""", ["pages_doc", "meta_b_raw"]),
    "url_join": ("SELECT doc_id, doc_key, file_pos, meta_url FROM url_pairs WHERE index_name = 'demo_b'", ["url_pairs"]),
    "uuid_join": ("SELECT doc_id, doc_key, file_pos, id FROM id_pairs WHERE index_name = 'demo_a'", ["id_pairs"]),
    "enrich_hits": ("SELECT index_name, doc_id, file_pos, mode, out_url FROM mapping", ["mapping"]),
    "lang_filter": ("""
SELECT s.request_id, s.doc_id, m.file_pos
FROM scores s JOIN valid v ON s.request_id = v.request_id
JOIN mapping m ON s.index_name = m.index_name AND s.doc_id = m.doc_id
WHERE v.lang IS NULL OR (m.language IS NOT NULL AND lower(m.language) = lower(v.lang))""",
                    ["scores", "valid", "mapping"]),
    "clean_fields": (f"SELECT index_name, file_pos, {java_trim('title')} AS title, {java_trim('language')} AS language FROM meta", ["meta"]),
    "text_snippet": (f"SELECT doc_id, {snippet('text')} AS snippet FROM documents", []),
    "word_count": (f"SELECT doc_id, {word_count('text')} AS word_count FROM documents", []),
    "warc_date": ("SELECT index_name, file_pos, warc_date FROM meta", ["meta"]),
    "result_rows": (f"""
SELECT index_name, file_pos, url, id, {java_trim('title')} AS title, {snippet('plain_text')} AS "textSnippet",
       {java_trim('language')} AS language, warc_date AS "warcDate", {word_count('plain_text')} AS "wordCount"
FROM meta""", ["meta"]),
    "rerank_word_count": ('SELECT request_id, CAST(rank AS BIGINT) AS rank, url, id, "wordCount" FROM results', ["results"]),
    "results_json": ("""
SELECT v.request_id,
       to_json({'results': COALESCE(
         (SELECT list({'url': r.url, 'id': r.id, 'title': r.title, 'textSnippet': r."textSnippet",
                       'language': r.language, 'warcDate': r."warcDate", 'wordCount': r."wordCount"}
                      ORDER BY r.rank)
          FROM results r WHERE r.request_id = v.request_id), [])}) AS json
FROM valid v""", ["valid", "results"]),
    "retrieve": ("""
SELECT request_id, CAST(rank AS BIGINT) AS rank, CAST(chunk_no AS BIGINT) AS chunk_no, page_content, source,
       id, title, language, "warcDate", "wordCount" FROM retrieved""", ["retrieved"]),
    "stuff_context": ("""
SELECT request_id, CAST(count(*) AS BIGINT) AS n_chunks,
       array_to_string(list(page_content ORDER BY rank, chunk_no), chr(10) || chr(10)) AS context
FROM retrieved GROUP BY request_id""", ["retrieved"]),
    "answer_sources": ("""
SELECT request_id, array_to_string(list(source ORDER BY rank, chunk_no), ' ') AS sources,
       array_to_string(list(source ORDER BY rank, chunk_no)[1:3], ' ') AS shown
FROM retrieved GROUP BY request_id""", ["retrieved"]),
    "reference_links": ("""
SELECT request_id, '<ul style=''font-size: 10px;''>' || chr(10)
  || array_to_string(list_transform(list(source ORDER BY rank, chunk_no)[1:3],
       lambda l: '<li><a href=''' || l || ''' target=''_blank''>' || l || '</a></li>' || chr(10)), '')
  || '</ul>' AS html
FROM retrieved GROUP BY request_id""", ["retrieved"]),
    "memory_window": ("""
SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10""", []),
    "memory_reset": ("""
SELECT c.conv_id, c.turn, c.role FROM conversations c
LEFT JOIN (SELECT conv_id, max(turn) AS last_reset FROM conversations WHERE role = 'system' GROUP BY conv_id) r
  ON c.conv_id = r.conv_id
WHERE (r.last_reset IS NULL OR c.turn > r.last_reset) AND c.role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY c.conv_id ORDER BY c.turn DESC) <= 10""", []),
    "dot_product": ("SELECT request_id, doc_id, round(CAST(dot AS DOUBLE), 6) AS dot FROM pair_sims", ["pair_sims"]),
    "cosine_similarity": ("""
SELECT request_id, doc_id,
       round(CASE WHEN den = 0 THEN 'NaN'::DOUBLE ELSE CAST(dot AS DOUBLE) / den END, 6) AS cosine
FROM pair_sims""", ["pair_sims"]),
    "semantic_rerank": ("""
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY
         CASE WHEN isnan(sim) THEN NULL ELSE sim END DESC NULLS LAST, rank) AS BIGINT) AS rank,
       doc_id, round(sim, 6) AS cosine
FROM (SELECT request_id, rank, doc_id,
             CASE WHEN den = 0 THEN 'NaN'::DOUBLE ELSE CAST(dot AS DOUBLE) / den END AS sim
      FROM pair_sims)""", ["pair_sims"]),
    "embed_distinct": ("""
SELECT t.request_id, CAST(t.rank AS BIGINT) AS rank, CAST(e.vec_id AS BIGINT) AS vec_id,
       round(sqrt(list_reduce(list_transform(e.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)),
                              lambda s, x: s + x, CAST(0 AS DOUBLE))), 6) AS norm
FROM (SELECT request_id, 0 AS rank, q AS text FROM valid
      UNION ALL SELECT request_id, rank, "textSnippet" FROM results) t
JOIN embeddings e ON length(t.text) % (SELECT count(*) FROM embeddings) = e.vec_id""", ["valid", "results"]),
    "chat_source": ("SELECT message_id, conv_id, turn, role, username, message FROM messages", ["messages"]),
    "message_router": (f"SELECT message_id, {ROUTE} AS route FROM messages", ["messages"]),
    "image_payload": (f"""
SELECT message_id, CAST(octet_length(from_base64(split_part(message, ',', 2))) AS BIGINT) AS n_bytes,
       decode(from_base64(split_part(message, ',', 2))) AS text
FROM messages WHERE {ROUTE} = 'image'""", ["messages"]),
    "caption_query": (f"""
SELECT m.message_id, {ROUTE} AS route,
       CASE WHEN {ROUTE} = 'image' THEN 'tell me about ' || c.caption ELSE m.message END AS query
FROM messages m LEFT JOIN captions c ON m.message_id = c.message_id
WHERE m.role = 'user'""", ["messages", "captions"]),
}


# chunk_text: the greedy splitter as a recursive CTE, one line per step.
_TAIL = "length(array_to_string(cur[j + 1:], chr(10)))"
_STRIP = "regexp_replace({x}, '^" + PY_WS + "+|" + PY_WS + "+$', '', 'g')"
CHUNK_SQL = f"""
WITH RECURSIVE st(doc_id, ls, i, out, cur, tot) AS (
  SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> ''), 0,
         CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), 0
  FROM documents
  UNION ALL
  SELECT doc_id, ls, i + 1,
    CASE WHEN ovf AND emitted <> '' THEN list_append(out, emitted) ELSE out END,
    CASE WHEN ovf THEN list_append(cur[j0 + 1:], d) ELSE list_append(cur, d) END,
    CASE WHEN ovf THEN length(array_to_string(cur[j0 + 1:], chr(10))) + length(d)
                       + CASE WHEN len(cur) - j0 > 0 THEN 1 ELSE 0 END
         ELSE tot + length(d) + CASE WHEN len(cur) > 0 THEN 1 ELSE 0 END END
  FROM (
    SELECT *, ls[i + 1] AS d,
      tot + length(ls[i + 1]) + CASE WHEN len(cur) > 0 THEN 1 ELSE 0 END > 1000 AND len(cur) > 0 AS ovf,
      {_STRIP.replace('{x}', 'array_to_string(cur, chr(10))')} AS emitted,
      list_filter(range(0, len(cur) + 1), lambda j: NOT ({_TAIL} > 200 OR
          ({_TAIL} + length(ls[i + 1]) + CASE WHEN len(cur) - j > 0 THEN 1 ELSE 0 END > 1000
           AND {_TAIL} > 0)))[1] AS j0
    FROM st WHERE i < len(ls))
)
SELECT doc_id, CAST(k - 1 AS BIGINT) AS chunk_no, chunk FROM (
  SELECT doc_id, unnest(chunks) AS chunk, unnest(range(1, len(chunks) + 1)) AS k FROM (
    SELECT doc_id,
      CASE WHEN {_STRIP.replace('{x}', 'array_to_string(cur, chr(10))')} <> ''
           THEN list_append(out, {_STRIP.replace('{x}', 'array_to_string(cur, chr(10))')})
           ELSE out END AS chunks
    FROM st QUALIFY i = max(i) OVER (PARTITION BY doc_id)))"""


def oracle_sql() -> dict[str, str]:
    out = {name: build(body, needs) for name, (body, needs) in ORACLE.items()}
    out["chunk_text"] = CHUNK_SQL.strip()
    return out


# ---- query forms -----------------------------------------------------------

cte("ftoks", ["valid"], f"""
SELECT v.request_id, v.index_name, regexp_extract_all(lower(b.text), '{TOKEN_RE}') AS toks
FROM valid v JOIN benchmark b ON v.request_id = b.item_id""")

IDF = "ln(1 + (c.n_docs - t.df + 0.5) / (t.df + 0.5))"
TFN = "(p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl)))"

# Every token of the passage is a clause; its place (from 1) gives the form.
cte("places", ["ftoks"], """
SELECT request_id, index_name, unnest(toks) AS term, generate_subscripts(toks, 1) AS i, len(toks) AS n FROM ftoks""")

# +first second third -fourth fifth AND sixth seventh NOT eighth ninth ...
cte("bclauses", ["places"], """
SELECT request_id, index_name, occur, term, count(*) AS w FROM (
  SELECT request_id, index_name, term,
         CASE WHEN i = 1 THEN 'MUST' WHEN i = n AND n > 6 THEN 'MUST_NOT' WHEN i IN (5, 6) AND n >= 6 THEN 'MUST'
              WHEN i = 4 THEN 'MUST_NOT' ELSE 'SHOULD' END AS occur
  FROM places)
GROUP BY request_id, index_name, occur, term""")

cte("bscores", ["bclauses", "term_stats", "corpus_stats", "postings"], f"""
SELECT h.request_id, h.doc_id,
       round(sum(CASE WHEN h.occur <> 'MUST_NOT' THEN h.contrib END), 6) AS score
FROM (SELECT q.request_id, p.doc_id, q.occur, q.w * {IDF} * {TFN} AS contrib
      FROM bclauses q JOIN term_stats t ON q.index_name = t.index_name AND q.term = t.term
      JOIN corpus_stats c ON q.index_name = c.index_name
      JOIN postings p ON q.index_name = p.index_name AND q.term = p.term) h
JOIN (SELECT request_id, count(*) FILTER (WHERE occur = 'MUST') AS n_must FROM bclauses GROUP BY request_id) n
  ON h.request_id = n.request_id
GROUP BY h.request_id, h.doc_id, n.n_must
HAVING count(*) FILTER (WHERE h.occur = 'MUST') = n.n_must
   AND count(*) FILTER (WHERE h.occur = 'MUST_NOT') = 0
   AND count(*) FILTER (WHERE h.occur <> 'MUST_NOT') > 0""")

# One phrase clause for every three consecutive tokens. The corpus tokens are
# cut down to query terms first.
cte("grams", ["places"], """
SELECT a.request_id, a.index_name, a.i AS clause, a.term AS t1, b.term AS t2, c.term AS t3
FROM places a JOIN places b ON b.request_id = a.request_id AND b.i = a.i + 1
JOIN places c ON c.request_id = a.request_id AND c.i = a.i + 2""")

cte("qtok", ["places", "tok"], """
SELECT index_name, doc_id, term, pos FROM tok
WHERE (index_name, term) IN (SELECT DISTINCT index_name, term FROM places)""")

cte("trigrams", ["qtok", "grams"], """
SELECT a.index_name, a.doc_id, a.term AS t1, b.term AS t2, d.term AS t3, count(*) AS freq
FROM qtok a
JOIN qtok b ON b.index_name = a.index_name AND b.doc_id = a.doc_id AND b.pos = a.pos + 1
JOIN qtok d ON d.index_name = a.index_name AND d.doc_id = a.doc_id AND d.pos = a.pos + 2
WHERE (a.index_name, a.term, b.term, d.term) IN (SELECT index_name, t1, t2, t3 FROM grams)
GROUP BY ALL""")

cte("qidf", ["term_stats", "corpus_stats", "places"], """
SELECT t.index_name, t.term, ln(1 + (c.n_docs - t.df + 0.5) / (t.df + 0.5)) AS idf
FROM term_stats t JOIN corpus_stats c ON t.index_name = c.index_name
WHERE (t.index_name, t.term) IN (SELECT DISTINCT index_name, term FROM places)""")

cte("pscores", ["grams", "trigrams", "qidf", "corpus_stats", "doc_len"], """
SELECT g.request_id, s.doc_id,
       round(sum((i1.idf + i2.idf + i3.idf) * s.freq / (s.freq + 1.2 * (0.25 + 0.75 * dl.dl / c.avgdl))), 6) AS score
FROM grams g
JOIN trigrams s ON s.index_name = g.index_name AND s.t1 = g.t1 AND s.t2 = g.t2 AND s.t3 = g.t3
JOIN corpus_stats c ON c.index_name = s.index_name
JOIN doc_len dl ON dl.index_name = s.index_name AND dl.doc_id = s.doc_id
JOIN qidf i1 ON i1.index_name = g.index_name AND i1.term = g.t1
JOIN qidf i2 ON i2.index_name = g.index_name AND i2.term = g.t2
JOIN qidf i3 ON i3.index_name = g.index_name AND i3.term = g.t3
GROUP BY g.request_id, s.doc_id""")

# A token's place modulo 4 gives its form: prefix of its first three
# characters, one-character wildcard at its second, regular expression on its
# first two, range up to the next token (open behind the last one).
cte("patterns", ["places"], """
SELECT DISTINCT p.index_name, p.i % 4 AS form, p.term, CASE WHEN p.i % 4 = 0 THEN q.term END AS upper
FROM places p LEFT JOIN places q ON q.request_id = p.request_id AND q.i = p.i + 1""")

cte("patterms", ["patterns", "term_stats"], """
SELECT p.index_name, p.form, p.term AS text, p.upper, t.term FROM patterns p JOIN term_stats t ON t.index_name = p.index_name
WHERE CASE p.form WHEN 1 THEN prefix(t.term, substr(p.term, 1, 3))
           WHEN 2 THEN length(t.term) = greatest(length(p.term), 2) AND substr(t.term, 1, 1) = substr(p.term, 1, 1)
                       AND substr(t.term, 3) = substr(p.term, 3)
           WHEN 3 THEN prefix(t.term, substr(p.term, 1, 2))
           ELSE t.term >= p.term AND (p.upper IS NULL OR t.term <= p.upper) END""")

cte("patdocs", ["patterms", "postings"], """
SELECT DISTINCT e.index_name, e.form, e.text, e.upper, p.doc_id
FROM patterms e JOIN postings p ON p.index_name = e.index_name AND p.term = e.term""")

cte("patscores", ["places", "patdocs"], """
SELECT p.request_id, d.doc_id, round(CAST(count(*) AS DOUBLE), 6) AS score
FROM (SELECT a.request_id, a.index_name, a.i % 4 AS form, a.term, CASE WHEN a.i % 4 = 0 THEN b.term END AS upper
      FROM places a LEFT JOIN places b ON b.request_id = a.request_id AND b.i = a.i + 1) p
JOIN patdocs d ON d.index_name = p.index_name AND d.form = p.form AND d.text = p.term
 AND d.upper IS NOT DISTINCT FROM p.upper
GROUP BY p.request_id, d.doc_id""")

# DuckDB's levenshtein counts bytes, Spark's counts characters: the few
# non-ASCII characters of the vocabulary are mapped one to one onto ASCII
# symbols that never occur in a lower-cased token before comparing.
cte("charmap", ["term_stats", "ftoks"], """
SELECT string_agg(ch, '' ORDER BY ch) AS src,
       string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&()*+,-./:;<=>?@[]^{|}~', CAST(rn AS INTEGER), 1), ''
                  ORDER BY ch) AS dst
FROM (SELECT ch, row_number() OVER (ORDER BY ch) AS rn FROM (
        SELECT DISTINCT unnest(string_split(term, '')) AS ch FROM term_stats
        UNION SELECT DISTINCT unnest(string_split(array_to_string(toks, ''), '')) FROM ftoks)
      WHERE unicode(ch) > 127)""")

cte("fzscores", ["places", "term_stats", "corpus_stats", "postings", "charmap"], """
SELECT x.request_id, p.doc_id,
       round(sum(x.sim * ln(1 + (c.n_docs - x.df_blend + 0.5) / (x.df_blend + 0.5))
                 * (p.tf / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avgdl)))), 6) AS score
FROM (SELECT *, max(df) OVER (PARTITION BY request_id, clause) AS df_blend FROM (
        SELECT *, row_number() OVER (PARTITION BY request_id, clause ORDER BY sim DESC, term) AS r FROM (
          SELECT q.request_id, q.index_name, q.clause, t.term, t.df,
                 1.0 - levenshtein(translate(t.term, m.src, m.dst), translate(q.qterm, m.src, m.dst))
                       / least(length(t.term), length(q.qterm)) AS sim
          FROM (SELECT request_id, index_name, i AS clause, term AS qterm,
                       CASE i % 3 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE CAST(least(floor((1 - CAST(0.8 AS DOUBLE)) * length(term)), 2) AS BIGINT) END AS k
                FROM places) q
          JOIN term_stats t ON t.index_name = q.index_name
           AND abs(length(t.term) - length(q.qterm)) <= q.k
          CROSS JOIN charmap m
          WHERE levenshtein(translate(t.term, m.src, m.dst), translate(q.qterm, m.src, m.dst)) <= q.k)
        WHERE sim > 0)
      WHERE r <= 50) x
JOIN corpus_stats c ON c.index_name = x.index_name
JOIN postings p ON p.index_name = x.index_name AND p.term = x.term
GROUP BY x.request_id, p.doc_id""")

cte("boostscores", ["places", "term_stats", "corpus_stats", "postings"], f"""
SELECT q.request_id, p.doc_id, round(sum(q.w * {IDF} * {TFN}), 6) AS score
FROM (SELECT request_id, index_name, term, sum(CASE i % 3 WHEN 1 THEN 2.0 WHEN 2 THEN 1.0 ELSE 0.5 END) AS w
      FROM places GROUP BY request_id, index_name, term) q
JOIN term_stats t ON q.index_name = t.index_name AND q.term = t.term
JOIN corpus_stats c ON q.index_name = c.index_name
JOIN postings p ON q.index_name = p.index_name AND q.term = p.term
GROUP BY q.request_id, p.doc_id""")

QDL = ("CASE WHEN p.dl < 24 THEN p.dl ELSE 24 + (((p.dl - 24) >> greatest(length(bin(p.dl - 24)) - 4, 0)) "
       "<< greatest(length(bin(p.dl - 24)) - 4, 0)) END")

cte("qscores", ["qt", "term_stats", "corpus_stats", "postings"], f"""
SELECT q.request_id, q.index_name, p.doc_id,
       round(sum(q.qtf * {IDF} * (p.tf / (p.tf + 1.2 * (0.25 + 0.75 * ({QDL}) / c.avgdl)))), 6) AS score
FROM qt q
JOIN term_stats t ON q.index_name = t.index_name AND q.term = t.term
JOIN corpus_stats c ON q.index_name = c.index_name
JOIN postings p ON q.index_name = p.index_name AND q.term = p.term
GROUP BY q.request_id, q.index_name, p.doc_id""")

ORACLE.update({
    "stream_memory": ("""
SELECT conv_id, turn, role FROM conversations WHERE role IN ('user', 'assistant')
QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 10""", []),
    "match_bool": ("SELECT request_id, doc_id, score FROM bscores", ["bscores"]),
    "match_phrase": ("SELECT request_id, doc_id, score FROM pscores", ["pscores"]),
    "match_pattern": ("SELECT request_id, doc_id, score FROM patscores", ["patscores"]),
    "match_fuzzy": ("SELECT request_id, doc_id, score FROM fzscores", ["fzscores"]),
    "boosted_terms": ("SELECT request_id, doc_id, score FROM boostscores", ["boostscores"]),
    "bm25_quantized": ("SELECT request_id, index_name, doc_id, score FROM qscores", ["qscores"]),
})


# ---- chat transcript ---------------------------------------------------------
# The search chain again, over one request per user message (the retriever's
# parameters: index demo_a, language en, limit 100, no ranking): each CTE of
# the chain is copied under a ``c_`` name with its references renamed.

_CHAIN = ["reqs", "validated", "valid", "qt", "scores", "ftopk", "result_rows", "results",
          "retrieved"]


def _copy_chain(prefix: str) -> None:
    """The chain over ``<prefix>raw_req`` under names with that prefix."""
    import re
    names = ["raw_req"] + _CHAIN
    pat = re.compile(r"\b(" + "|".join(names) + r")\b")
    for n in _CHAIN:
        deps, sql = CTES[n]
        CTES[prefix + n] = ([(prefix + d) if d in names else d for d in deps],
                            pat.sub(lambda m: prefix + m.group(1), sql))


def _chat_chain() -> None:
    cte("c_raw_req", ["messages", "captions"], """
SELECT m.message_id AS request_id,
       CASE WHEN prefix(m.message, 'data:image/jpeg;base64,') THEN 'tell me about ' || c.caption
            ELSE m.message END AS q,
       'demo_a' AS "index", 'en' AS lang, CAST(NULL AS VARCHAR) AS ranking,
       CAST(100 AS INTEGER) AS "limit"
FROM messages m LEFT JOIN captions c ON m.message_id = c.message_id
WHERE m.role = 'user'""")
    _copy_chain("c_")
    cte("answers", [], """
SELECT CAST(u.conv_id AS VARCHAR) || '-' || CAST(u.turn AS VARCHAR) AS message_id, a.text AS answer
FROM conversations u JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")
    cte("transcript", ["messages", "c_raw_req", "c_retrieved", "answers"], """
SELECT message_id, CAST(0 AS BIGINT) AS seq, username, message AS text FROM messages WHERE role = 'user'
UNION ALL
SELECT r.request_id AS message_id, CAST(1 AS BIGINT) AS seq, 'ai' AS username,
       '<div style=''text-align: left''>' || COALESCE(a.answer, '') || '<br/><br/> References: <br/>'
       || '<ul style=''font-size: 10px;''>' || chr(10)
       || COALESCE(array_to_string(list_transform(s.shown,
            lambda l: '<li><a href=''' || l || ''' target=''_blank''>' || l || '</a></li>' || chr(10)), ''), '')
       || '</ul>' || '</div>' AS text
FROM c_raw_req r
LEFT JOIN (SELECT request_id, list(source ORDER BY rank, chunk_no)[1:3] AS shown
           FROM c_retrieved GROUP BY request_id) s ON r.request_id = s.request_id
LEFT JOIN answers a ON r.request_id = a.message_id""")


_chat_chain()

# The server's requests as the retriever sends them: 100 results and ``en``
# where a request names neither.
cte("r_raw_req", ["raw_req"], """
SELECT request_id, q, COALESCE("index", 'demo_a') AS "index", COALESCE(lang, 'en') AS lang, ranking,
       CAST(COALESCE("limit", 100) AS INTEGER) AS "limit"
FROM raw_req""")
_copy_chain("r_")
for _name in ("retrieve", "stuff_context", "answer_sources", "reference_links"):
    ORACLE[_name] = (ORACLE[_name][0].replace("FROM retrieved", "FROM r_retrieved"), ["r_retrieved"])

ORACLE.update({
    "stream_memory_reset": ORACLE["memory_reset"],
    "embed_memo": ("""
SELECT kind, id, CAST(length(text) AS BIGINT) AS n_chars, CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS n_blanks,
       CAST(NULL AS VARCHAR) AS error
FROM (SELECT 'request' AS kind, request_id AS id, q AS text FROM valid
      UNION ALL SELECT 'document', doc_id, text FROM documents)""", ["valid"]),
    "stream_transcript": ("SELECT message_id, seq, username, text FROM transcript", ["transcript"]),
    "stream_search": ("SELECT message_id, seq, username, text FROM transcript", ["transcript"]),
})
