"""Secret scanning with corpus-wide ownership, DataFrame functions only.

Patterns find candidates in every text.  A candidate's value is counted over
the whole corpus by distinct owners and repositories: a value that many owners
hold, or one owner in many repositories, is a copied example; a value that one
owner holds in few looks like a live credential.  The base spans are always reported; the method adds a ``live``
span for every candidate value that its ownership marks so, including tokens of
mixed characters that no base pattern finds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import content_key, materialize, parallel

# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "live")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: What runs over a text: a failing run of HEX or ACCESS holds no match, so the
#: shortest admitted length can stand in the pattern; a failing ASSIGN match
#: uses up what it has read and is dropped afterwards.
SCAN = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Further candidates: long tokens with lower case, upper case and digits.
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MIXED = r"^(?=.*[a-z])(?=.*[A-Z])(?=.*[0-9]).*$"

#: Spans that are listed at a time.
CHUNK = 128
#: Most repositories that hold a live value; a value in more is a copied example.
MAX_REPOS = 5

_SPAN = "struct<start:int, kind:int, end:int, value:string>"


def _spans(text: Column, kind: int, pattern: str, value: int = 0) -> Column:
    """Matches of ``pattern`` as spans in code points: the texts between the
    matches give their places.  ``value`` is the group that holds the secret,
    always at the end of the match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else hits
    gaps = F.split(text, pattern, -1)
    parts = F.arrays_zip(hits.alias("hit"), gaps.alias("gap"), values.alias("value"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["gap"])
        end = start + F.length(p["hit"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    none = F.array().cast(f"array<{_SPAN}>")
    start = lambda at: F.struct(at.alias("at"), none.alias("spans"))

    # A step copies the list it adds to, so lists stay short: CHUNK spans each,
    # and a list of those.
    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, start(acc["at"]), step)
        return F.struct(done["at"].alias("at"), F.concat(acc["spans"], F.array(done["spans"])).alias("spans"))

    def run(all_parts: Column) -> Column:
        first = F.sequence(F.lit(1), F.greatest(F.size(all_parts), F.lit(1)), F.lit(CHUNK))
        chunks = F.transform(first, lambda k: F.slice(all_parts, k, F.lit(CHUNK)))
        whole = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{_SPAN}>>").alias("spans"))
        return F.aggregate(chunks, whole, chunk, lambda a: F.flatten(a["spans"]))

    # bound in a lambda, the parts are made once
    parts = F.array(F.filter(parts, lambda p: p["hit"].isNotNull()))
    return F.when(text.rlike(pattern), F.transform(parts, run)[0]).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by start and kind."""
    found = [_spans(text, kind, SCAN[name], 2 if name == "assign" else 0)
             for kind, name in enumerate(("assign", "access", "hex"))]
    found[0] = F.filter(found[0], lambda s: F.length(s["value"]) >= LEAST["assign"])
    return F.array_sort(F.concat(*found))


def token_spans(text: Column) -> Column:
    """Tokens of mixed characters, as candidates."""
    return F.filter(_spans(text, KINDS.index("live"), TOKEN), lambda s: s["value"].rlike(MIXED))


def render(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def ownership(candidates: DataFrame, max_owners: int = 1, max_repos: int = MAX_REPOS) -> DataFrame:
    """(value key va, vb, n_owners, n_repos, live) of candidates (va, vb, owner,
    repo and the text's key ka, kb).  A hot value's rows are first reduced to
    distinct (value, owner, repository), dealt by all three, then counted per
    owner; null owners and repositories count as one each.

    A value is live if at most ``max_owners`` owners hold it, in at most
    ``max_repos`` repositories of theirs together; exact copies of a text count
    as one repository."""
    each = candidates.groupBy("va", "vb", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("va", "vb", "owner").agg(F.count("*").alias("repos"))
    out = by_owner.groupBy("va", "vb").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    texts = candidates.groupBy("va", "vb", "ka", "kb").agg(F.lit(1).alias("one"))
    texts = texts.groupBy("va", "vb").agg(F.count("*").alias("n_texts"))
    out = out.join(texts, ["va", "vb"]).withColumn("n_repos", F.least("n_repos", "n_texts")).drop("n_texts")
    return out.withColumn("live", (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", max_owners: int = 1,
         max_repos: int = MAX_REPOS) -> DataFrame:
    """doc_id, base and found (arrays of start, kind, end, value) of every row.

    ``base`` are the base spans; ``found`` also holds the live ones.  A null
    text is empty and has none.  Repeated rows are scanned alike; equal texts
    get equal spans, since a value's standing is one for the whole corpus.
    """
    text = F.coalesce("text", F.lit(""))
    key = content_key(text)
    seen = parallel(docs).select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repo).cast("string").alias("repo"),
                                 key["a"].alias("ka"), key["b"].alias("kb"), base_spans(text).alias("base"), token_spans(text).alias("tokens"))
    seen = materialize(seen, "secrets")  # spans only, no text
    each = F.explode(F.concat("base", "tokens"))
    value = content_key("s.value")
    cand = seen.select("owner", "repo", "ka", "kb", each.alias("s")).select(
        "owner", "repo", "ka", "kb", value["a"].alias("va"), value["b"].alias("vb"),
        F.struct((F.col("s.end") - F.length("s.value")).alias("start"), F.lit(KINDS.index("live")).alias("kind"),
                 F.col("s.end").alias("end"), F.col("s.value").alias("value")).alias("s"))
    live = ownership(cand, max_owners, max_repos).where("live").select("va", "vb")
    # A live value has few owners; its spans are gathered once per distinct text.
    marked = cand.select("ka", "kb", "va", "vb", "s").distinct().join(live, ["va", "vb"], "left_semi")
    # stored, so that the join can split the rows of one text's many copies
    marked = materialize(marked.groupBy("ka", "kb").agg(F.collect_set("s").alias("live")), "live-spans")
    rows = seen.drop("tokens").join(marked, ["ka", "kb"], "left")
    found = F.array_sort(F.concat("base", F.coalesce("live", F.array().cast(f"array<{_SPAN}>"))))
    return rows.select("doc_id", "base", found.alias("found"))


def scan_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (all spans) of
    every row of docs (doc_id, source, text)."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return scan(docs, **options).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(F.encode(render(F.col("base")), "UTF-8"), 256).alias("base_sha256"), render(F.col("found")).alias("spans"))
