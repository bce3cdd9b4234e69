"""Question-answering preparation: chunking, context stuffing, conversation
memory, answer sources and reference links. All per-row work is built-in
higher-order functions; per-group work is bounded by a request's limit or
by the memory size k (a literal, so top-k is planned with a partial limit).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ranklake.config import CHUNK_OVERLAP, CHUNK_SIZE, MEMORY_EXCHANGES, SOURCES_SHOWN

# Python's str.isspace() set (what str.strip() removes), as a Java class.
PY_WS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"

# Fixed values of the reference's link list markup.
LINKS_OPEN = "<ul style='font-size: 10px;'>\n"
LINK_ITEM = ("<li><a href='", "' target='_blank'>", "</a></li>\n")
LINKS_CLOSE = "</ul>"
ANSWER_OPEN = "<div style='text-align: left'>"
ANSWER_REFS = "<br/><br/> References: <br/>"
ANSWER_CLOSE = "</div>"
CONTEXT_SEPARATOR = "\n\n"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def py_strip(col) -> Column:
    return F.regexp_replace(_c(col), f"^{PY_WS}+|{PY_WS}+$", "")


def chunk_text(col, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Greedy newline-separated chunker with overlap, as one ``aggregate``
    over the non-empty lines. State: emitted chunks, current lines and the
    length of the current lines joined by newlines. When the next line would
    overflow, the current chunk is emitted and leading lines are dropped
    until the rest is at most ``overlap`` long and leaves room for the line.
    A single line longer than ``size`` stays one chunk."""
    lines = F.filter(F.split(_c(col), "\n", -1), lambda x: x != "")
    empty = F.array().cast("array<string>")
    init = F.struct(empty.alias("out"), empty.alias("cur"), F.lit(0).alias("tot"))

    def joined_len(cur, i):
        return F.length(F.array_join(F.slice(cur, i + 1, F.size(cur) - i), "\n"))

    def step(acc, d):
        out, cur, tot = acc.getField("out"), acc.getField("cur"), acc.getField("tot")
        n = F.size(cur)
        ln = F.length(d)
        plain = F.struct(out.alias("out"), F.concat(cur, F.array(d)).alias("cur"),
                         (tot + ln + F.when(n > 0, 1).otherwise(0)).alias("tot"))

        def keeps(i):
            t = joined_len(cur, i)
            room = t + ln + F.when(n - i > 0, 1).otherwise(0)
            return ~((t > overlap) | ((room > size) & (t > 0)))

        first_i = F.filter(F.sequence(F.lit(0), n), keeps)[0]
        emitted = py_strip(F.array_join(cur, "\n"))
        new_out = F.when(F.length(emitted) > 0, F.concat(out, F.array(emitted))).otherwise(out)

        def after_drop(_acc, i):
            kept = F.slice(cur, i + 1, n - i)
            k = F.size(kept)
            return F.struct(new_out.alias("out"), F.concat(kept, F.array(d)).alias("cur"),
                            (F.length(F.array_join(kept, "\n")) + ln
                             + F.when(k > 0, 1).otherwise(0)).alias("tot"))

        dropped = F.aggregate(F.array(first_i), acc, after_drop)
        return F.when((tot + ln + F.when(n > 0, 1).otherwise(0) > size) & (n > 0), dropped) \
            .otherwise(plain)

    def finish(acc):
        last = py_strip(F.array_join(acc.getField("cur"), "\n"))
        return F.when(F.length(last) > 0, F.concat(acc.getField("out"), F.array(last))) \
            .otherwise(acc.getField("out"))

    return F.aggregate(lines, init, step, finish)


def explode_chunks(df: DataFrame, text_col: str, keep: list[str],
                   size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, chunked: bool = False) -> DataFrame:
    """One row per chunk: ``keep`` columns, ``chunk_no`` (0-based), ``chunk``.
    ``chunked``: ``text_col`` holds what ``chunk_text`` made."""
    chunks = _c(text_col) if chunked else chunk_text(text_col, size, overlap)
    return df.select(*keep, F.posexplode(chunks).alias("chunk_no", "chunk"))


def stuff_context(chunks: DataFrame, group: str = "request_id",
                  order: tuple[str, ...] = ("rank", "chunk_no"),
                  text_col: str = "chunk", max_chars: int | None = None) -> DataFrame:
    """All chunks of a request in order, joined by a blank line. With
    ``max_chars`` the first chunks that fit into so many characters together,
    whole; a request whose first chunk does not fit has no row."""
    if max_chars is not None:
        w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        used = F.sum(F.length(text_col) + len(CONTEXT_SEPARATOR)).over(w) - len(CONTEXT_SEPARATOR)
        chunks = chunks.withColumn("_used", used).filter(F.col("_used") <= max_chars).drop("_used")
    item = F.struct(*[F.col(c) for c in order], F.col(text_col).alias("_t"))
    return (chunks.groupBy(group)
            .agg(F.sort_array(F.collect_list(item)).alias("_items"))
            .select(group, F.size("_items").alias("n_chunks"),
                    F.array_join(F.transform("_items", lambda x: x.getField("_t")),
                                 CONTEXT_SEPARATOR).alias("context")))


def context_and_sources(chunks: DataFrame, group: str = "request_id",
                        order: tuple[str, ...] = ("rank", "chunk_no"), text_col: str = "chunk",
                        source_col: str = "source", shown: int = SOURCES_SHOWN) -> DataFrame:
    """``stuff_context`` and ``answer_sources`` from one aggregation (one
    pass over the chunks instead of two). Texts and sources are gathered apart,
    each with its place, so that a reader of the sources alone moves no texts."""
    def item(col):
        return F.struct(*[F.col(c) for c in order], F.col(col).alias("_v"))

    def values(items):
        return F.transform(F.sort_array(items), lambda x: x.getField("_v"))

    return (chunks.groupBy(group)
            .agg(F.count(F.lit(1)).cast("int").alias("n_chunks"),
                 F.array_join(values(F.collect_list(item(text_col))), CONTEXT_SEPARATOR).alias("context"),
                 values(F.collect_list(item(source_col))).alias("sources"))
            .withColumn("shown", F.slice("sources", 1, shown)))


def answer_sources(chunks: DataFrame, group: str = "request_id",
                   order: tuple[str, ...] = ("rank", "chunk_no"),
                   source_col: str = "source", shown: int = SOURCES_SHOWN) -> DataFrame:
    """Source of every chunk in order (duplicates kept) and the first
    ``shown`` of them."""
    item = F.struct(*[F.col(c) for c in order], F.col(source_col).alias("_s"))
    srcs = F.transform(F.sort_array(F.collect_list(item)), lambda x: x.getField("_s"))
    return (chunks.groupBy(group).agg(srcs.alias("sources"))
            .withColumn("shown", F.slice("sources", 1, shown)))


def reference_links(links_col) -> Column:
    """``<ul>`` list with one ``<li><a>`` per link."""
    a, b, c = LINK_ITEM
    items = F.transform(_c(links_col), lambda l_: F.concat(F.lit(a), l_, F.lit(b), l_, F.lit(c)))
    return F.concat(F.lit(LINKS_OPEN), F.array_join(items, ""), F.lit(LINKS_CLOSE))


def answer_html(answer_col, links_html_col) -> Column:
    return F.concat(F.lit(ANSWER_OPEN), _c(answer_col), F.lit(ANSWER_REFS),
                    _c(links_html_col), F.lit(ANSWER_CLOSE))


def memory_window(messages: DataFrame, k: int = MEMORY_EXCHANGES,
                  conv_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Last ``k`` exchanges (2k user/assistant messages) per conversation."""
    m = messages.filter(F.col("role").isin("user", "assistant"))
    w = Window.partitionBy(conv_col).orderBy(F.col(order_col).desc())
    return (m.withColumn("_r", F.row_number().over(w))
            .filter(F.col("_r") <= 2 * k).drop("_r"))


def memory_reset(messages: DataFrame, k: int = MEMORY_EXCHANGES,
                 reset_col: str = "is_reset", conv_col: str = "conv_id",
                 order_col: str = "turn") -> DataFrame:
    """Memory after the last reset of each conversation: a hash aggregate
    finds the last reset turn (combined map-side), a join keeps what
    follows, then ``memory_window``."""
    last = (messages.filter(F.col(reset_col))
            .groupBy(conv_col).agg(F.max(order_col).alias("_last_reset")))
    kept = (messages.join(last, conv_col, "left")
            .filter(F.col("_last_reset").isNull() | (F.col(order_col) > F.col("_last_reset")))
            .drop("_last_reset"))
    return memory_window(kept, k, conv_col, order_col)
