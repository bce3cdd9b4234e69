"""License scanning by an exact set-similarity join, DataFrame functions only.

Templates and text blocks are sets of words.  A block holds a license when it
contains ``threshold`` of a template's words.  Words are ordered by how many
documents hold them, rarest first; of a template with L words that needs a
common ones, one of the first L - a + 1 must stand in the block (prefix
filter), so only documents with such a word are cut into blocks.  A block with
fewer than a known words is out (length filter), and so is a pair whose first
common word leaves too few behind it on either side (positional filter).  Pairs
left over are counted.

A block is a window of twice the template's longest extent that moves by half
its size, so a template that stands in the text lies whole in some block.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.llm.common import materialize, parallel

# The base phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

# Widely used license notices, by label.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the"
            " following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
            " license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
            " documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]

#: A word of a text whose A-Z are lower case, and of any text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

THRESHOLD = 0.9
#: Half the words of a block; a template takes the smallest that holds it.
STRIDES = (8, 16, 32, 64)


def words_of(text: Column) -> Column:
    """The words of a text, A-Z lower-cased."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def _any_of(wanted: list[str]) -> str:
    """A pattern for texts of any case that hold one of the phrases as whole words."""
    each = "|".join(sorted({_BETWEEN.join(map(re.escape, w.split())) for w in wanted}))
    return rf"(?i)(?<!{_IN_WORD})(?:{each})(?!{_IN_WORD})"


def template_table(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    """Templates as sets with the words they need, at their stride."""
    out = []
    for number, (label, text) in enumerate(templates):
        extent, words = len(text.split()), sorted(set(text.split()))
        stride = next((s for s in STRIDES if s >= extent), extent)
        out.append({"template": number, "label": label, "words": words, "stride": stride,
                    "need": math.ceil(round(threshold * len(words), 9))})
    return out


def word_order(docs: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary (the templates' words) by the number of documents that
    hold each, rarest first."""
    spark = docs.sparkSession
    # as many rows as the templates have words
    known = F.broadcast(spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0)))
    held = docs.select(F.explode(words).alias("word")).select(F.translate("word", UPPER, LOWER).alias("word"))
    counts = {r.word: r.n for r in held.join(known, "word").groupBy("word").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def blocks(words: DataFrame, order: list[str], strides: list[int]) -> DataFrame:
    """(rid, stride, block, held): the known words of each block of rows (rid,
    pos, word), as ranks in ascending order."""
    spark = words.sparkSession
    rank = F.broadcast(spark.createDataFrame(list(enumerate(order)), "rank int, word string"))
    at = F.explode(F.array(*[F.struct(F.lit(s).alias("stride"), (F.floor(F.col("pos") / s) - k).alias("block"))
                             for s in strides for k in (0, 1)]))
    known = words.join(rank, "word").select("rid", "rank", at.alias("at"))
    return known.groupBy("rid", "at.stride", "at.block").agg(F.sort_array(F.collect_set("rank")).alias("held"))


def similarity_join(blocks_: DataFrame, templates: list[dict], order: list[str]) -> DataFrame:
    """(rid, stride, block, template, label, containment) of every block and
    template of its stride that meet the template's need."""
    spark = blocks_.sparkSession
    ranks = {w: k for k, w in enumerate(order)}
    index = []
    for t in templates:
        mine = sorted(ranks[w] for w in t["words"])
        index += [(r, t["stride"], t["template"], t["label"], mine, t["need"], place)
                  for place, r in enumerate(mine[:len(mine) - t["need"] + 1])]
    side = F.broadcast(spark.createDataFrame(index, "rank int, stride int, template int, label string, ranks array<int>, need int, place int"))
    each = blocks_.select("rid", "stride", "block", "held", F.posexplode("held").alias("pos", "rank"))
    left = F.least(F.size("ranks") - F.col("place"), F.size("held") - F.col("pos"))
    pairs = each.join(side, ["rank", "stride"]).where((F.size("held") >= F.col("need")) & (left >= F.col("need")))
    common = F.size(F.array_intersect("held", "ranks"))
    hits = pairs.where(common >= F.col("need")).select(
        "rid", "stride", "block", "template", "label", (common / F.size("ranks")).alias("containment"))
    return hits.groupBy("rid", "stride", "block", "template").agg(
        F.first("label").alias("label"), F.first("containment").alias("containment"))


def _places(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    here = lambda i: F.slice(words, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    return F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), here)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (per base phrase, arrays of word places),
    base_labels, labels, score (arrays and the largest containment) of every row
    of docs (doc_id, text).

    Labels are those of the base phrases that stand in the text and of the
    templates that some block contains.  The score is 1 for a base phrase, else
    the largest containment of such a block, else 0.  A null text is empty and
    has no word.  Repeated rows are scanned alike; further columns are ignored;
    an empty table gives an empty one.
    """
    text = F.coalesce("text", F.lit(""))
    slim = parallel(docs.select("doc_id", text.alias("text")))
    table = template_table(templates, threshold)
    order = word_order(slim, sorted({w for t in table for w in t["words"]}))
    ranks = {w: k for k, w in enumerate(order)}
    first = {w for t in table for w in sorted(t["words"], key=ranks.get)[:len(t["words"]) - t["need"] + 1]}
    base, near = F.col("text").rlike(_any_of([p for p, _ in PHRASES])), F.col("text").rlike(_any_of(sorted(first)))
    # Only texts with a base phrase or a word of some prefix are cut into words.
    none = F.array().cast("array<string>")
    seen = slim.select("doc_id", "text", F.size(F.regexp_extract_all("text", F.lit(WORD_ANY_CASE), F.lit(0))).cast("long").alias("n_words"),
                       base.alias("base"), near.alias("near"))
    seen = seen.withColumn("words", F.when(F.col("base") | F.col("near"), words_of(F.col("text"))).otherwise(none))
    places = F.array(*[F.when(F.col("base"), _places(F.col("words"), p)).otherwise(F.array().cast("array<int>")) for p, _ in PHRASES])
    seen = materialize(seen.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "n_words", places.alias("places"),
                                   F.when(F.col("near"), F.col("words")).alias("words")), "license-words")
    cut = blocks(seen.select("rid", F.posexplode("words").alias("pos", "word")), order, sorted({t["stride"] for t in table}))
    found = similarity_join(cut, table, order).groupBy("rid").agg(
        F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    rows = seen.drop("words").join(found, "rid", "left")
    labels = F.array(*[F.when(F.size(F.col("places")[k]) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)])
    rows = rows.withColumn("base_labels", F.array_sort(F.filter(labels, lambda x: x.isNotNull())))
    return rows.select(
        "doc_id", "n_words", "places", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", none))).alias("labels"),
        F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"))


def scan_digest(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels
    (comma-joined) and score of every row of docs (doc_id, text)."""
    every = F.flatten("places")
    return scan(docs, **options).select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")
