"""Edge rows of FIXTURES.md §3, evaluated through the column expressions."""

import math
import random

import pytest
import regex
from pyspark.sql import functions as F

from ranklake.functions import (cosine_similarity, quantized_length, text_snippet,
                                url_schema_a, url_schema_b, warc_date_schema_a,
                                warc_date_schema_b, word_count)
from ranklake.functions.text import tokens
from ranklake.functions.url import url_match_keys


def one_col(spark, values, schema, expr):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_word_count(spark):
    vals = ["", "   ", "\n", "a b c", " a b", "a b "]
    assert one_col(spark, vals, "x string", word_count("x")) == [1, 0, 0, 3, 3, 2]


def test_text_snippet(spark):
    vals = ["aa\nbbb\nccc", "", "\n\n", "  a  \nbb"]
    assert one_col(spark, vals, "x string", text_snippet("x")) == ["bbb", "", "", "a"]


def test_url_schema_a(spark):
    vals = ["<http://x.org/p>", "<<http://x.org>", "http://x.org>"]
    assert one_col(spark, vals, "u string", url_schema_a("u")) == [
        "http://x.org/p", "<http://x.org", "http://x.org"]


def test_url_schema_b(spark):
    df = spark.createDataFrame(
        [("https", "", "x", "org", "", "", ""), ("https", "www", "x", "co.uk", "/p", "a=1", "top")],
        "s string, sub string, d string, suf string, p string, q string, f string")
    got = [r[0] for r in df.select(url_schema_b("s", "sub", "d", "suf", "p", "q", "f")).collect()]
    assert got == ["https://x.org", "https://www.x.co.uk/p?a=1#top"]


def test_url_join_keys_equal_or_join(spark):
    pairs = [("http://a", "http://a", True), ("http://a", "http://a/", True),
             ("http://a/", "http://a", True), ("http://a/", "http://a//", True),
             ("http://a", "http://a//", False), ("http://A", "http://a", False)]
    df = spark.createDataFrame(pairs, "l string, p string, expect boolean")
    got = df.select("expect", F.array_contains(url_match_keys("p"), F.col("l")).alias("m")).collect()
    assert all(r.expect == r.m for r in got)


def test_warc_date(spark):
    a = one_col(spark, ["2023-05-01T10:00:00Z", "not-a-date"], "x string", warc_date_schema_a("x"))
    assert a == ["1682935200000000", "not-a-date"]
    b = one_col(spark, [1682935200000000], "x long", warc_date_schema_b("x"))
    assert b == ["1682935200000000"]


def test_cosine(spark):
    df = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [-1.0, 0.0]),
         ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    got = [r[0] for r in df.select(cosine_similarity("a", "b")).collect()]
    assert got[:3] == [1.0, 0.0, -1.0] and math.isnan(got[3])


def test_quantized_length(spark):
    vals = [23, 24, 39, 40, 41, 100, 385, 1000]
    assert one_col(spark, vals, "x long", quantized_length("x")) == [23, 24, 39, 40, 40, 96, 376, 984]


GOLDEN = [
    ("Can't stop: 3.14 and 1,000,000.50 at example.com.", ["can't", "stop", "3.14", "and", "1,000,000.50", "at", "example.com"]),
    ("a.5 1.a v1.2.3 U.S.A. a::b a:b 'x'", ["a", "5", "1", "a", "v1.2.3", "u.s.a", "a", "b", "a:b", "x"]),
    ("foo_bar __x__ ___ co-op C++", ["foo_bar", "__x__", "co", "op", "c"]),
    ("東京タワー ひら カタ語", ["東", "京", "タワー", "ひ", "ら", "カタ", "語"]),
    ("salát a­b l’été 한국어", ["salát", "a­b", "l’été", "한국어"]),
    ("สวัสดี ๑", ["สวัสดี", "๑"]),
    ("", []), ("... ́", []), (None, None),
]


def test_uax29_golden(spark):
    got = one_col(spark, [t for t, _ in GOLDEN], "x string", tokens("x", "uax29_like"))
    assert got == [k for _, k in GOLDEN]
    with pytest.raises(ValueError, match="no analyser"):
        tokens("x", "other")


def test_uax29_against_unicode_boundaries(spark, sf):
    """The tokens are the pieces between the Unicode word boundaries that hold
    a letter or a digit, on all documents and on drawn strings; long runs of
    underscores and of letters with dots stay linear."""
    draw = random.Random(7)
    # Marks stand between letters (beside a joining sign the module splits where WB4 does not), and
    # apostrophes are left to the golden rows (it has a rule of its own for those before vowels).
    signs = [*"ab_.,:; 1\u0661\u6771\u3072\u30ab\u30fc\ud55c\u0436-\n", "e\u0301b", "a\u00adb"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 40))) for _ in range(1500)] + ["_" * 50_000 + " " + "a." * 50_000]
    texts += [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect() if r.text is not None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", tokens("x", "uax29_like").alias("t")).collect()
    for r in got:
        pieces = regex.split(r"\b", r.x.lower(), flags=regex.WORD | regex.V1)
        assert r.t == [p for p in pieces if regex.search(r"[\p{Alphabetic}\p{Nd}]", p)], r.x[:80]
