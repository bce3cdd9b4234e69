"""Registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ranklake.llm import (ann, embedding_dedup, html_extract, license_scan, line_dedup, mixing, packing, reversed_search, secret_scan,
                          sharding, simhash, spelling, toxicity)
from ranklake.sources.tables import read_table


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(read_table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_digest(read_table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read_table(spark, sf_dir, "pages"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_digest(spark, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"), words=3, bits=2)


def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.ranking(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=20)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_digest(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_sharding, op3_line_dedup, op4_embedding_dedup, op5_secret_scan, op6_html,
                           op7_packing, op8_nearest, op9_toxicity, op10_simhash, op11_reversed_search,
                           op12_spelling, op13_license_scan)
}

#: Lines split at the line feed; a key is the line without blanks at its ends,
#: A-Z lower-cased.  Every row is a document.
LINE_DEDUP_SQL = """
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT rid, unnest(parts) AS line, generate_subscripts(parts, 1) AS no FROM docs),
keyed AS (SELECT rid, line, no, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
marked AS (SELECT k.rid, k.no, CASE WHEN h.key IS NULL THEN k.line END AS kept FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT d.doc_id, count(*) AS n_lines, count(*) - count(m.kept) AS n_dropped,
       sha256(coalesce(string_agg(m.kept, chr(10) ORDER BY m.no), '')) AS kept_sha256
FROM docs d JOIN marked m ON d.rid = m.rid GROUP BY d.rid, d.doc_id
"""


def _spans_sql(name: str, kind: int, pattern: str, least: int, group: int) -> str:
    """Matches with their places: the texts between the matches are what is
    left of a split at the pattern."""
    value = f"regexp_extract_all(text, '{pattern}', {group})"
    return f"""
{name} AS (SELECT rid, start, {kind} AS kind, start + length(hit) AS stop, value FROM (
  SELECT rid, hits[i] AS hit, vals[i] AS value,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(text, '{pattern}') AS hits, {value} AS vals, string_split_regex(text, '{pattern}') AS gaps
    FROM docs WHERE regexp_matches(text, '{pattern}'))))
  WHERE length(value) >= {least})"""


def _secret_sql() -> str:
    q = lambda p: p.replace("'", "''")
    parts = [_spans_sql("s_assign", 0, q(secret_scan.ASSIGN), 6, 2), _spans_sql("s_access", 1, secret_scan.ACCESS, 20, 0),
             _spans_sql("s_hex", 2, secret_scan.HEX, 24, 0), _spans_sql("s_token", 3, secret_scan.TOKEN, 20, 0)]
    name = "CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'live' END || ':' || start || ':' || stop"
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),{",".join(parts)},
base AS (SELECT * FROM s_assign UNION ALL SELECT * FROM s_access UNION ALL SELECT * FROM s_hex),
cand AS (SELECT * FROM base UNION ALL SELECT * FROM s_token
         WHERE regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[0-9]')),
live AS (SELECT value FROM cand JOIN docs USING (rid) GROUP BY value
         HAVING count(DISTINCT source) + max(CASE WHEN source IS NULL THEN 1 ELSE 0 END) <= 1
            AND least(count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END), count(DISTINCT text)) <= {secret_scan.MAX_REPOS}),
marks AS (SELECT DISTINCT rid, stop - length(value) AS start, 3 AS kind, stop, value FROM cand WHERE value IN (SELECT value FROM live)),
found AS (SELECT * FROM base UNION ALL SELECT * FROM marks),
b AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg({name}, ',' ORDER BY start, kind, stop) AS txt FROM base GROUP BY rid),
f AS (SELECT rid, string_agg({name}, ',' ORDER BY start, kind, stop) AS txt FROM found GROUP BY rid)
SELECT d.doc_id, coalesce(b.n_assign, 0) AS n_assign, coalesce(b.n_access, 0) AS n_access, coalesce(b.n_hex, 0) AS n_hex,
       sha256(coalesce(b.txt, '')) AS base_sha256, coalesce(f.txt, '') AS spans
FROM docs d LEFT JOIN b USING (rid) LEFT JOIN f USING (rid)
"""


EMBEDDING_SQL = """
WITH RECURSIVE rows AS (SELECT row_number() OVER () AS rid, vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
good AS (SELECT * FROM rows WHERE v IS NOT NULL AND len(v) > 0
         AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
link AS (SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.rid <> b.rid AND len(a.v) = len(b.v)
         AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT rid AS r, rid AS t FROM rows UNION SELECT reach.r, link.b FROM reach JOIN link ON reach.t = link.a),
comp AS (SELECT r, min(vec_id) AS component_id FROM reach JOIN rows ON rid = t GROUP BY r),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM rows JOIN comp ON comp.r = rid LEFT JOIN n ON n.a = rid
"""

#: Terms, counts and scores in whole numbers, but for the weight of a term.
SEARCH_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
              regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
items AS (SELECT row_number() OVER () AS iid, item_id,
              regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
tf AS (SELECT rid, t, count(*) AS tf FROM (SELECT rid, unnest(ts) AS t FROM docs) GROUP BY rid, t),
n AS (SELECT rid, sum(tf) AS n FROM tf GROUP BY rid),
total AS (SELECT count(*) AS nd, sum(n) AS nt FROM n),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * df + 1))) AS BIGINT) AS w FROM df, total),
m AS (SELECT rid, CAST(100 - 25 + ((25 * n * nd) // nt) AS BIGINT) AS m FROM n, total),
q AS (SELECT iid, t, count(*) AS qtf FROM (SELECT iid, unnest(ts) AS t FROM items) GROUP BY iid, t),
scored AS (SELECT iid, rid, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM q JOIN w USING (t) JOIN tf USING (t) JOIN m USING (rid) GROUP BY iid, rid),
ranked AS (SELECT iid, doc_id, score, CAST(row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id ASC NULLS LAST) AS INTEGER) AS rank
           FROM scored JOIN docs USING (rid) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked JOIN items USING (iid) WHERE rank <= 20
"""

#: The checksum as shifts over the bytes of ``<doc_id>:<run>``; near words are
#: those that agree when the character at one place is left out of one or both.
SPELLING_SQL = """
WITH crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
             lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
runs AS (SELECT did, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS did,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
         WHERE length(run) >= 7 GROUP BY did, run),
bytes AS (SELECT run, n, flatten(list_transform(string_split(did || ':' || run, ''), lambda ch:
          CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [CAST(192 + unicode(ch) // 64 AS BIGINT), CAST(128 + unicode(ch) % 64 AS BIGINT)] END)) AS bs FROM runs),
hashed AS (SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM bytes, crc),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 31 = 0
          THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
          WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cuts AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT DISTINCT a.word AS word, b.word AS other, b.n AS bn FROM cuts a JOIN cuts b ON a.i = b.i AND a.cut = b.cut AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
         UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(m := -bn, o := other)) AS best FROM near GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * w.n THEN best.o END AS form,
                 CASE WHEN -best.m >= 10 * w.n THEN -best.m END AS form_n FROM words w LEFT JOIN best USING (word)),
path AS (SELECT word, word AS root, 0 AS d FROM forms),
p1 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM path p JOIN forms f ON p.root = f.word),
p2 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p1 p JOIN forms f ON p.root = f.word),
p3 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p2 p JOIN forms f ON p.root = f.word),
p4 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p3 p JOIN forms f ON p.root = f.word),
p5 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p4 p JOIN forms f ON p.root = f.word),
p6 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p5 p JOIN forms f ON p.root = f.word),
p7 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p6 p JOIN forms f ON p.root = f.word),
p8 AS (SELECT p.word, coalesce(f.form, p.root) AS root FROM p7 p JOIN forms f ON p.root = f.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN p8 USING (word)
"""


def _license_sql() -> str:
    """Base phrases by the words that follow each other; templates against every
    block of every document."""
    rows = ", ".join(f"({t['template']}, '{t['label']}', {t['stride']}, {t['need']}, {t['words']!r})"
                     for t in license_scan.template_table(license_scan.TEMPLATES, license_scan.THRESHOLD))
    phrases = ", ".join(f"('{label}', {p.split()!r})" for p, label in license_scan.PHRASES)
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(
              translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS ws FROM documents),
phrase(label, parts) AS (VALUES {phrases}),
place AS (SELECT rid, label, i FROM (SELECT rid, ws, unnest(range(len(ws))) AS i FROM docs), phrase WHERE ws[i+1:i+len(parts)] = parts),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM place GROUP BY rid),
template(tid, label, stride, need, parts) AS (VALUES {rows}),
known AS (SELECT tid, stride, unnest(parts) AS word FROM template),
toks AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS pos FROM docs),
held AS (SELECT rid, tid, pos // stride - k AS block, count(DISTINCT t.word) AS c
         FROM toks t JOIN known USING (word), (VALUES (0), (1)) AS both_blocks(k) GROUP BY rid, tid, pos // stride - k),
hit AS (SELECT rid, list_sort(list_distinct(list(label))) AS labels, max(CAST(c AS DOUBLE) / len(parts)) AS score
        FROM held JOIN template USING (tid) WHERE c >= need GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(b.labels, ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(h.labels, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(h.score, 0) END AS score
FROM docs LEFT JOIN base b USING (rid) LEFT JOIN hit h USING (rid)
"""


ORACLE_SQL: dict[str, str] = {"op11_reversed_search": SEARCH_SQL, "op12_spelling": SPELLING_SQL, "op13_license_scan": _license_sql(),
                              "op4_embedding_dedup": EMBEDDING_SQL, "op3_line_dedup": LINE_DEDUP_SQL, "op5_secret_scan": _secret_sql()}
