"""Query forms as clause tables.

A clause table has one row per query clause::

    request_id, index_name, limit, clause_no, occur, kind, text, upper,
    inclusive, max_edits, boost

``occur`` is MUST / SHOULD / MUST_NOT, ``kind`` one of term, phrase,
prefix, wildcard, regex, range, fuzzy. Every request of a table is
evaluated in the same job (``ranklake.operators.scoring``).

``plain_clauses`` is the default operator OR over the analysed text.
``clauses_from_q`` maps the flat, whitespace-separated forms of the classic
query syntax (``+a``, ``-a``, ``!a``, ``a AND b``, ``a OR b``, ``NOT a``,
``"a b"``, ``ab*``, ``a?c``, ``/re/``, ``[a TO b]``, ``{a TO b}``, ``a~``,
``a~1``, ``a~0.8``, ``a^2``) to clauses with column expressions. It is not a
grammar: parentheses are read as white space and there are no field prefixes.
AND makes the clauses on both its sides required, unless one is prohibited; NOT
prohibits the next one. A bare word that the analyser splits in several tokens
gives one clause per token with the word's occur.

``query_error`` is true for a ``q`` that these forms cannot read; such a request
is answered with status 500 by ``validate_requests`` and no other request of the
table is touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.config import FUZZY_MAX_EDITS
from ranklake.functions.text import DEFAULT_ANALYSER, tokens

MUST, SHOULD, MUST_NOT = "MUST", "SHOULD", "MUST_NOT"

CLAUSE_COLUMNS = ["request_id", "index_name", "limit", "clause_no", "occur", "kind",
                  "text", "upper", "inclusive", "max_edits", "boost"]

_ITEM = (r'[+!-]?(?:"[^"]*"(?:~[0-9.]+)?|\[[^\]]*\]|\{[^}]*\}|/(?:[^/\\]|\\.)+/|[^\s"()]+)'
         r'(?:\^[0-9]+(?:\.[0-9]+)?)?')
_BOOST = r"\^([0-9]+(?:\.[0-9]+)?)$"
_RANGE = r"^[\[{](\S*)\s+TO\s+(\S*)[\]}]$"
_FUZZY = r"~([0-9]*(?:\.[0-9]+)?)$"
_AND, _OR, _NOT = ("AND", "&&"), ("OR", "||"), ("NOT", "!")

# Regular expressions that are taken: atoms with quantifiers, alternatives,
# character classes and groups, up to this depth.
_REGEX_DEPTH = 3
_ATOMS = r"(?:[^\[\](){}*+?|\\](?:[*+?]|\{[0-9]{1,4}(?:,[0-9]{0,4})?\})?|\|)*"


def _items(q) -> Column:
    return F.regexp_extract_all(q, F.lit(_ITEM), F.lit(0))


def _body(item: Column) -> Column:
    """An item without its sign and boost."""
    return F.regexp_replace(F.regexp_replace(item, r"^[+!-](?=.)", ""), _BOOST, "")


def regex_ok(text: Column) -> Column:
    """Whether a regular expression is one of the taken forms, so that no
    pattern of one request can fail the job of a whole table."""
    classes = F.regexp_extract_all(text, F.lit(r".-."), F.lit(0))
    counts = F.regexp_extract_all(text, F.lit(r"\{([0-9]{1,4}),([0-9]{1,4})\}"), F.lit(0))
    falling = F.exists(classes, lambda r: F.substring(r, 1, 1) > F.substring(r, 3, 1)) | F.exists(
        counts, lambda c: F.regexp_extract(c, r"([0-9]+),", 1).cast("int") > F.regexp_extract(c, r",([0-9]+)", 1).cast("int"))
    s = F.regexp_replace(text, r"\\[^A-Za-z0-9]", "x")
    s = F.regexp_replace(s, r"\[\^?[^\[\]\\&^]+\]", "x")
    for _ in range(_REGEX_DEPTH):
        s = F.regexp_replace(s, r"\((?:\?:)?" + _ATOMS + r"\)", "x")
    return s.rlike("^" + _ATOMS + "$") & ~falling


def query_error(q) -> Column:
    """True if ``q`` is null, blank or cannot be read: a quote or bracket
    without its partner, a phrase with slop, a wildcard at the start of a word,
    a bad regular expression, or an operator without its clauses."""
    q = F.col(q) if isinstance(q, str) else q
    # One-element array: the items are made once and the checks share them.
    held = F.array(F.struct(F.coalesce(q, F.lit("")).alias("q"), _items(F.coalesce(q, F.lit(""))).alias("items")))
    return F.exists(held, lambda x: _unreadable(x["q"], x["items"]))


def _unreadable(q: Column, items: Column) -> Column:
    is_op = lambda x: x.isin(*_AND, *_OR, *_NOT)
    is_not = lambda x: x.isin(*_NOT)

    def bad(item: Column) -> Column:
        b = _body(item)
        return (F.when(b.rlike(r'^".*"(?:~[0-9.]+)?$'), b.rlike(r"~[0-9.]+$"))
                .when(b.rlike(r"^/.+/$"), ~regex_ok(b.substr(F.lit(2), F.length(b) - 2)))
                .when(b.rlike(r"^[\[{]"), ~b.rlike(_RANGE))
                .otherwise(b.rlike(r"[\[\]{}\"]|^[*?]|^/") | b.rlike(r"~[0-9]*\.[0-9]*\.") | (b == "")))
    after = F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0)))
    pairs = F.zip_with(items, after, lambda x, y: F.coalesce(is_op(x) & is_op(y) & ~(is_not(y) & ~is_not(x)), F.lit(False)))
    ends = F.coalesce(is_op(F.try_element_at(items, F.lit(-1))), F.lit(False))
    first = F.coalesce(F.try_element_at(items, F.lit(1)), F.lit(""))
    return (~q.rlike(r"\S") | F.regexp_replace(q, _ITEM, "").rlike(r"[^\s()]") | F.exists(items, lambda x: ~is_op(x) & bad(x))
            | ends | (is_op(first) & ~is_not(first)) | F.exists(pairs, lambda p: p))


def _req_cols(requests: DataFrame):
    lim = F.col("limit") if "limit" in requests.columns else F.lit(None).cast("int")
    return [F.col("request_id"), F.col("index_name"), lim.cast("int").alias("limit")]


def query_terms(requests: DataFrame, analyser: str = DEFAULT_ANALYSER) -> DataFrame:
    """(request_id, index_name, term, qtf): analysed terms of ``q``; a term
    repeated in the query counts as often as it appears."""
    return (requests.select(*_req_cols(requests)[:2], F.explode(tokens("q", analyser)).alias("term"))
            .groupBy("request_id", "index_name", "term")
            .agg(F.count(F.lit(1)).cast("long").alias("qtf")))


def plain_clauses(requests: DataFrame, analyser: str = DEFAULT_ANALYSER) -> DataFrame:
    """One SHOULD term clause per analysed token of ``q`` (default OR)."""
    return (requests.select(*_req_cols(requests), F.posexplode(tokens("q", analyser)).alias("clause_no", "text"))
            .select("request_id", "index_name", "limit",
                    F.col("clause_no").cast("long").alias("clause_no"),
                    F.lit(SHOULD).alias("occur"), F.lit("term").alias("kind"), "text",
                    F.lit(None).cast("string").alias("upper"),
                    F.lit(True).alias("inclusive"),
                    F.lit(None).cast("int").alias("max_edits"),
                    F.lit(1.0).alias("boost")))


def clauses_from_q(requests: DataFrame, analyser: str = DEFAULT_ANALYSER) -> DataFrame:
    """Flat query-syntax items of ``q`` -> clause table (see module doc);
    ``analyser`` is that of the index which is asked."""
    items = requests.select(*_req_cols(requests), _items("q").alias("items"))
    items = items.select("request_id", "index_name", "limit", "items", F.posexplode("items").alias("item_no", "item"))
    near = lambda k: F.coalesce(F.try_element_at("items", F.col("item_no") + 1 + k), F.lit(""))
    # index 0 is no element; the first item has none before it
    prev = F.when(F.col("item_no") >= 1, near(-1)).otherwise(F.lit(""))
    before = F.when(F.col("item_no") >= 2, near(-2)).otherwise(F.lit(""))
    joined = prev.isin(*_AND) | (prev.isin(*_NOT) & before.isin(*_AND)) | near(1).isin(*_AND)
    items = items.withColumns({"denied": prev.isin(*_NOT), "joined": joined})
    items = items.filter(~F.col("item").isin(*_AND, *_OR, *_NOT))
    sign = F.substring("item", 1, 1)
    occur = (F.when(F.col("denied") | sign.isin("-", "!"), F.lit(MUST_NOT))
             .when((sign == "+") | F.col("joined"), F.lit(MUST)).otherwise(F.lit(SHOULD)))
    # Each step is its own projection, so that no expression is repeated.
    parsed = items.select(
        "request_id", "index_name", "limit", "item_no", occur.alias("occur"),
        F.regexp_extract("item", _BOOST, 1).alias("boost_txt"), _body(F.col("item")).alias("body"))
    b = F.col("body")
    kind = (F.when(b.rlike(r'^".*"$'), "phrase").when(b.rlike(_RANGE), "range").when(b.rlike(r"^/.+/$"), "regex")
            .when(b.rlike("[^~]" + _FUZZY), "fuzzy").when(b.rlike(r"^[^*?]+\*$"), "prefix")
            .when(b.rlike(r"[*?]"), "wildcard").otherwise("term"))
    parsed = parsed.withColumn("kind", kind)
    k = F.col("kind")
    parsed = parsed.withColumn("text", F.lower(
        F.when(k.isin("phrase", "regex"), b.substr(F.lit(2), F.length(b) - 2))
        .when(k == "range", F.regexp_extract(b, _RANGE, 1))
        .when(k == "fuzzy", F.regexp_replace(b, _FUZZY, ""))
        .when(k == "prefix", F.regexp_replace(b, r"\*$", ""))
        .otherwise(b)))
    # a~n: at most n edits; a~0.x: the edits that keep a similarity of 0.x
    near_by = F.when(k == "fuzzy", F.regexp_extract(b, _FUZZY, 1).try_cast("double"))
    edits = F.when(near_by >= 1, F.least(near_by, F.lit(FUZZY_MAX_EDITS))).when(near_by == 0, F.lit(0)) \
        .when(near_by < 1, F.least(F.floor((1 - near_by) * F.length("text")), F.lit(FUZZY_MAX_EDITS))) \
        .otherwise(F.lit(FUZZY_MAX_EDITS))
    typed = parsed.select(
        "request_id", "index_name", "limit", "item_no", "occur",
        F.coalesce(F.col("boost_txt").try_cast("double"), F.lit(1.0)).alias("boost"), "kind", "text",
        F.when(k == "range", F.lower(F.regexp_extract(b, _RANGE, 2))).alias("upper"),
        F.when(k == "range", b.startswith("[")).otherwise(F.lit(True)).alias("inclusive"),
        F.when(k == "fuzzy", edits.cast("int")).alias("max_edits"))
    # Bare words go through the analyser; each token becomes a term clause.
    words = (typed.filter(F.col("kind") == "term")
             .select("request_id", "index_name", "limit", "item_no", "occur", "boost",
                     "kind", F.posexplode(tokens("text", analyser)).alias("sub", "text"),
                     "upper", "inclusive", "max_edits"))
    others = typed.filter(F.col("kind") != "term").withColumn("sub", F.lit(0))
    out = words.unionByName(others)
    return out.select(
        "request_id", "index_name", "limit",
        (F.col("item_no").cast("long") * (1 << 24) + F.col("sub")).alias("clause_no"),
        "occur", "kind", "text", "upper", "inclusive",
        F.col("max_edits").cast("int").alias("max_edits"), "boost")
