"""Reversed search, spelling variants and license scans against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from ranklake.llm import license_scan, reversed_search, spelling

from .fixtures import documents, no_documents, rows

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark).cache()


ITEMS = [(1, "alpha beta beta omega"), (2, "Gamma, DELTA! été"), (3, None), (4, "..."), (5, "no such thing"), (1, "alpha beta beta omega"),
         (None, "secret token"), (6, "one two " * 40)]


def brute_search(data, items, k=20):
    docs = [(d, TERM.findall(lower(t))) for d, t in data]
    docs = [(d, ts) for d, ts in docs if ts]
    big_n, big_l = len(docs), sum(len(ts) for _, ts in docs)
    df = Counter(t for _, ts in docs for t in set(ts))
    out = []
    for item, text in items:
        hits = []
        for d, ts in docs:
            tf, m = Counter(ts), 75 + 25 * len(ts) * big_n // big_l
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 12 * m))
                        for t in TERM.findall(lower(text)) if t in tf)
            if score > 0:
                hits.append((-score, d is None, d or 0))
        out += [(item, r + 1, None if null else d, -s) for r, (s, null, d) in enumerate(sorted(hits)[:k])]
    return Counter(out)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_search_against_brute_force(spark, docs, block_bytes):
    items = spark.createDataFrame([(*x, 1, "c") for x in ITEMS], "item_id long, text string, rank int, doc_id string")
    out = reversed_search.search(docs, items, k=5, block_bytes=block_bytes).collect()
    assert Counter((r.item_id, r.rank, r.doc_id, r.score) for r in out) == brute_search([(d[0], d[1]) for d in rows()], ITEMS, 5)
    assert {r.text for r in out} <= {t for _, t in ITEMS}


def test_search_ties_and_batches(spark, monkeypatch):
    """Copies tie by doc_id, across heaps, batches and tasks."""
    data = [(i, "same words here") for i in range(60, 0, -1)] + [(None, "same words here"), (99, "other")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    items = spark.createDataFrame([(7, "words")], "item_id long, text string")
    out = reversed_search.ranking(df, items, k=4).collect()
    assert sorted((r.rank, r.doc_id) for r in out) == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert reversed_search.ranking(df, items, k=100).count() == 61
    heaps = reversed_search.Heaps(1, 2)
    import numpy as np
    heaps.take([5, 4], np.array([[3], [3]]))
    heaps.take([None, 1], np.array([[3], [3]]))
    heaps.take([0], np.array([[0]]))
    assert sorted((s, -d) for s, _, d in heaps.heaps[0]) == [(3, 1), (3, 4)]


def test_search_of_nothing(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert reversed_search.ranking(docs, none).count() == 0
    some = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert reversed_search.ranking(no_documents(spark), some).count() == 0


RUNS = re.compile("[A-Za-zÀ-ÿ]+")


def brute_words(data, least=7, at_least=2):
    total = Counter()
    for d, text in data:
        for run in RUNS.findall(text or ""):
            w = lower(run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= at_least}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_group(words, factor=10):
    out = {}
    near = {w: [v for v in words if v != w and one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best is not None and words[best] >= factor * n else None, len(near[w]))
    def root(w):
        return w if out[w][0] is None else root(out[w][0])
    return {(w, f, root(w), words[w], k, words.get(f)) for w, (f, k) in out.items()}


def typos(rng, n=120):
    letters = "abcdeéñÿ÷"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(7, 15))) for _ in range(20)]
    got = Counter()
    for _ in range(n):
        w = rng.choice(base)
        i, c = rng.randrange(len(w) + 1), rng.choice(letters)
        w = rng.choice([w, w[:i] + c + w[i:], w[:i] + c + w[i + 1:], w[:i] + w[i + 1:]])
        got[w] += rng.choice([2, 3, 30, 400, 5000])
    got.update({"aaaaaaa": 3, "aaaaaaaa": 40, "aaaaaaaaa": 400, "abababab": 2, "babababa": 20, "a" * 3000: 2, "a" * 3001: 20})
    return {w: n for w, n in got.items() if len(w) >= 6}


@pytest.mark.parametrize("rare", [0, 3, 500])
def test_variants_of_random_words(spark, rare):
    """Every pair, with a dictionary of all grams, of some and of none."""
    words = typos(random.Random(rare))
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    out = spelling.group(df, rare=rare).collect()
    assert len(out) == len(words)
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute_group(words)


def test_words_against_brute_force(spark, docs):
    long_run = "Abcdefghi" * 400
    extra = [(500 + i, f"ÉTÉORANGE étéorange STRASSE×÷ wordword{i}wordword orangerie_orangeries", "en", "s", 1, 1, 1, 1, "x") for i in range(70)]
    extra += [(900, long_run, "en", "s", 1, 1, 1, 1, "x"), (901, long_run + " " + long_run, "en", "s", 1, 1, 1, 1, "x")]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    data = [(d[0], d[1]) for d in [*rows(), *extra]]
    words = brute_words(data)
    assert {r.word: r.n for r in spelling.word_counts(df).collect()} == words
    out = spelling.variants(df).collect()
    assert {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in out} == brute_group(words)
    assert len(out) == len(words)
    assert spelling.variants(no_documents(spark)).count() == 0


def test_affected_bound_holds():
    """An edit never changes more grams than the bound says."""
    rng = random.Random(3)
    words = [spelling.FIRST + "".join(rng.choice("abc") for _ in range(rng.randrange(7, 16))) + spelling.LAST for _ in range(400)]
    counts = Counter(w[i:i + q] for w in words for q in range(3, 6) for i in range(len(w) - q + 1))
    for rare in (0, 5, 40):
        known = {g: n for g, n in counts.items() if n > rare}
        suffixes = spelling.tails(known)
        for s in words:
            grams = spelling.decompose(s, known)
            bound = spelling.affected(s, grams, suffixes)
            for i in range(1, len(s)):
                for t in (s[:i] + "b" + s[i:], s[:i] + "c" + s[i + 1:], s[:i] + s[i + 1:]):
                    if t[-1] != spelling.LAST:
                        continue
                    other = spelling.decompose(t, known)
                    there = {(t[p:e + 1], p) for p, e in other} | {(t[p:e + 1], p - len(t)) for p, e in other}
                    kept = sum((s[p:e + 1], p) in there or (s[p:e + 1], p - len(s)) in there for p, e in grams)
                    assert len(grams) - kept <= bound


LICENSES = [
    "Licensed under the Apache License, Version 2.0.", "x CC-BY cc by\ncc  BY-NC 4.0. Licensed under it", "General Public\nLicense! all Rights reserved (All rights  reserved)",
    "ccc by", "cc byé", "kcc by", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated\n * documentation"
    " files (the \"Software\"), to deal in the Software", "filler word " * 37 + "released under the MIT license " + "more text " * 40,
    "released " + "far " * 30 + "under the mit license", "the mit released license under", "GNU", "cc by " * 3000, "This program is free software; you can redistribute it",
]


def brute_license(text):
    words = re.findall(license_scan.WORD, lower(text))
    at = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words))
          if words[i:i + len(phrase.split())] == phrase.split()]
    base, best, more = {label for _, label in at}, 0.0, set()
    for t in license_scan.template_table(license_scan.TEMPLATES, license_scan.THRESHOLD):
        s = t["stride"]
        for start in range(-s, len(words), s):
            share = len(set(words[max(0, start):start + 2 * s]) & set(t["words"]))
            if share >= license_scan.THRESHOLD * len(t["words"]) - 1e-9:
                more.add(t["label"])
                best = max(best, share / len(t["words"]))
    places = [i for i, _ in at]
    return (len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | more)), 1.0 if base else best)


def test_license_scan_against_brute_force(spark, docs):
    extra = [(700 + i, t, "en", "s", 1, 1, 1, 1, "x") for i, t in enumerate(LICENSES)]
    df = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    out = license_scan.scan_digest(df).collect()
    want = Counter((d[0], *brute_license(d[1])) for d in [*rows(), *extra])
    assert Counter(tuple(r) for r in out) == want
    assert {r.labels for r in out} >= {"", "apache-2.0", "mit", "cc-by,cc-by-nc"}
    assert license_scan.scan_digest(no_documents(spark)).count() == 0


def test_license_scan_is_native(spark, docs):
    plan = license_scan.scan_digest(docs)._jdf.queryExecution().toString()
    assert not re.search(r"Python|Pandas|Arrow|MapPartitions|Cartesian|BroadcastNestedLoop", plan)
    assert license_scan.scan(docs).columns == ["doc_id", "n_words", "places", "base_labels", "labels", "score"]


def test_whole_tables_equal_sql(spark, sf):
    """The registered queries against DuckDB on the smallest tables."""
    import duckdb

    from ranklake.llm import queries
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    for name in ("op11_reversed_search", "op12_spelling", "op13_license_scan"):
        df = queries.QUERIES[name](spark, sf)
        cols = ", ".join(df.columns)
        want = con.execute(f"SELECT {cols} FROM ({queries.ORACLE_SQL[name]})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert Counter(got) == Counter(want), name
