"""Column expressions over text: analyser, Java-compatible trim, split and
the longest-line snippet. All of them are built-in Spark expressions, so
they stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ranklake.config import TOKEN_PATTERN

# Java's \s class; RE2 and Java agree on this explicit form.
JAVA_WS = "[ \\t\\n\\x0B\\f\\r]"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# Character classes of the Unicode word boundary rules (UAX #29), by property.
_MARK = r"[\p{M}\p{Cf}]*+"
_KATAKANA = r"[\p{IsKatakana}\u30FC\uFF70]"
_MAINLAND = r"\p{IsThai}\p{IsLao}\p{IsMyanmar}\p{IsKhmer}"
_LETTER = rf"[\p{{IsAlphabetic}}&&[^\p{{IsIdeographic}}\p{{IsHiragana}}{_KATAKANA}{_MAINLAND}\p{{M}}]]"
# What joins two letters, and what joins two digits.
_MID_LETTER = r"[:'.\u00B7\u2018\u2019\u2024\u2027\uFE13\uFE52\uFE55\uFF07\uFF0E\uFF1A]"
_MID_NUMBER = r"[,;'.\u037E\u0589\u2018\u2019\u2024\u2044\uFE10\uFE14\uFE50\uFE52\uFE54\uFF07\uFF0C\uFF0E\uFF1B]"


def _joined(unit: str, joiner: str) -> str:
    run = rf"{unit}(?:{unit}|[\p{{M}}\p{{Cf}}])*+"
    return rf"{run}(?:{joiner}{_MARK}{run})*+"


# Every repetition is possessive: none has to give anything back, and a long
# token costs no stack. The look-behind keeps a run of underscores linear.
_UNIT = rf"(?:(?:{_joined(_LETTER, _MID_LETTER)}|{_joined(r'\p{Nd}', _MID_NUMBER)})++|(?:{_KATAKANA}{_MARK})++)"
_LINK = rf"(?:\p{{Pc}}{_MARK})++"
UAX29_PATTERN = (rf"(?:(?<!\p{{Pc}}){_LINK})?+{_UNIT}(?:{_LINK}{_UNIT})*+(?:{_LINK})?+"
                 rf"|[[{_MAINLAND}]&&[\p{{L}}\p{{M}}]]++|[\p{{IsIdeographic}}\p{{IsHiragana}}]{_MARK}")

#: Analysers by name: the pattern whose matches in the lower-cased text are the
#: tokens. ``words`` takes runs of letters, digits and underscores;
#: ``uax29_like`` follows the Unicode word boundaries: ``can't``, ``3.14`` and
#: ``example.com`` are whole, ideographs and Hiragana come one by one, a run of
#: Katakana or of a script without spaces is one token. It has no dictionary
#: for these scripts, and emoji are no tokens.
ANALYSERS = {"words": TOKEN_PATTERN, "uax29_like": UAX29_PATTERN}
DEFAULT_ANALYSER = "words"


def tokens(col, analyser: str = DEFAULT_ANALYSER) -> Column:
    """Analyser: lower case, then every match of the analyser's pattern."""
    if analyser not in ANALYSERS:
        raise ValueError(f"no analyser named {analyser}; there are {', '.join(ANALYSERS)}")
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(ANALYSERS[analyser]), 0)


def java_trim(col) -> Column:
    """``String.trim``: drop every char <= U+0020 at both ends."""
    return F.regexp_replace(_c(col), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def text_snippet(col) -> Column:
    """Longest line of the text (first one wins a tie), then trimmed."""
    lines = F.split(_c(col), "\n", -1)
    longest = F.aggregate(
        lines, F.lit(""),
        lambda acc, y: F.when(F.length(y) > F.length(acc), y).otherwise(acc))
    return java_trim(longest)


def word_count(col) -> Column:
    """``text.split("\\s+").length`` with Java's split rules.

    Trailing empty pieces are dropped, a leading one is kept, and an empty
    input yields one piece.
    """
    x = _c(col)
    r = F.regexp_replace(x, JAVA_WS + "+$", "")
    return (F.when(x == "", F.lit(1))
            .when(r == "", F.lit(0))
            .otherwise(F.size(F.split(r, JAVA_WS + "+", -1)))).cast("int")


#: Characters of a word's beginning that its deletion signatures read.
SIGNATURE_PREFIX = 8


def deletion_signatures(col: str, deletions: int = 2) -> Column:
    """Hashes of what is left of a word's first ``SIGNATURE_PREFIX`` characters
    after up to ``deletions`` (0 to 2) of them are deleted. Two words within so
    many edits share one; their number is bounded, however long the word is."""
    def cut(s: Column) -> Column:
        places = F.when(F.length(s) > 0, F.sequence(F.lit(1), F.length(s))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(s.substr(F.lit(1), i - 1), s.substr(i + 1, F.lit(SIGNATURE_PREFIX))))

    start = F.substring(col, 1, SIGNATURE_PREFIX)
    kept = F.array(start)
    if deletions > 0:
        kept = F.concat(kept, cut(start))
    if deletions > 1:
        kept = F.concat(kept, F.flatten(F.transform(cut(start), cut)))
    return F.transform(F.array_distinct(kept), lambda s: F.xxhash64(s))


def exploded_signatures(df: DataFrame, col: str) -> DataFrame:
    """``df`` with a row for each of the deletion signatures (``sig``) of up to
    two deletions: of every two places in the beginning that is read, what
    stands before, between and behind them. No lambda, so it stays in codegen;
    a signature that two pairs of places give comes twice."""
    none = SIGNATURE_PREFIX + 1  # the first place behind the beginning
    pairs = [(none, none + 1)] + [(i, j) for i in range(1, none) for j in range(i + 1, none + 1)]
    places = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in pairs])
    start, i, j, n = F.col("_start"), F.col("_cut.i"), F.col("_cut.j"), F.col("_n")
    kept = F.concat(start.substr(F.lit(1), i - 1), start.substr(i + 1, j - i - 1), start.substr(j + 1, F.lit(SIGNATURE_PREFIX)))
    rows = (df.withColumn("_start", F.substring(col, 1, SIGNATURE_PREFIX)).withColumn("_n", F.length("_start"))
            .withColumn("_cut", F.explode(places)))
    return (rows.filter((i == none) | ((i <= n) & ((j == none) | (j <= n))))
            .withColumn("sig", F.xxhash64(kept)).drop("_start", "_n", "_cut"))
