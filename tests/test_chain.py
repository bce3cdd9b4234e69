"""Chunker, memory and sources."""

from pyspark.sql import functions as F

from ranklake.operators import chain
from ranklake.sources.tables import read_table


def py_chunks(text, size=1000, overlap=200):
    """Plain-Python replay of the greedy splitter."""
    lines = [s for s in text.split("\n") if s != ""]
    out, cur, tot = [], [], 0
    for d in lines:
        n = len(d)
        if tot + n + (1 if cur else 0) > size:
            if cur:
                doc = "\n".join(cur).strip()
                if doc:
                    out.append(doc)
                while tot > overlap or (tot + n + (1 if cur else 0) > size and tot > 0):
                    tot -= len(cur[0]) + (1 if len(cur) > 1 else 0)
                    cur = cur[1:]
        cur.append(d)
        tot += n + (1 if len(cur) > 1 else 0)
    doc = "\n".join(cur).strip()
    if doc:
        out.append(doc)
    return out


def chunks_of(spark, texts, size=1000, overlap=200):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [list(r[0]) for r in df.select(chain.chunk_text("t", size, overlap)).collect()]


def test_chunk_edges(spark):
    texts = ["", "x" * 1500, "\n".join(["a" * 600] * 3), "\n".join(["a" * 700, "b" * 150, "c" * 400])]
    got = [[len(c) for c in cs] for cs in chunks_of(spark, texts)]
    assert got == [[], [1500], [600, 600, 600], [851, 551]]


def test_chunks_equal_python_replay(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text").collect()
    for size, overlap in [(1000, 200), (300, 150)]:
        got = chunks_of(spark, [d.text for d in docs], size, overlap)
        assert got == [py_chunks(d.text, size, overlap) for d in docs]


def test_memory_window_k2(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted(r.turn for r in chain.memory_window(df, k=2).collect())
    assert got == [3, 4, 5, 6]


def test_memory_reset(spark):
    rows = [(1, 0, "user", False), (1, 1, "assistant", False), (1, 2, "user", True),
            (1, 3, "user", False), (1, 4, "assistant", False)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, is_reset boolean")
    got = sorted(r.turn for r in chain.memory_reset(df, k=5).collect())
    assert got == [3, 4]


def test_sources_and_links(spark):
    rows = [(1, 2, 0, "u2"), (1, 1, 0, "u1"), (1, 1, 1, "u1"), (1, 3, 0, "u3")]
    df = spark.createDataFrame(rows, "request_id long, rank int, chunk_no int, source string")
    s = chain.answer_sources(df).collect()[0]
    assert list(s.sources) == ["u1", "u1", "u2", "u3"] and list(s.shown) == ["u1", "u1", "u2"]
    html = spark.createDataFrame([(["a"],)], "l array<string>").select(
        chain.reference_links("l")).first()[0]
    assert html == ("<ul style='font-size: 10px;'>\n<li><a href='a' target='_blank'>a</a></li>\n"
                    "</ul>")


def test_stuff_context(spark):
    rows = [(1, 2, 0, "b"), (1, 1, 0, "a")]
    df = spark.createDataFrame(rows, "request_id long, rank int, chunk_no int, chunk string")
    r = chain.stuff_context(df).first()
    assert r.context == "a\n\nb" and r.n_chunks == 2
    assert F is not None


def test_context_budget(spark):
    """Whole chunks up to a budget; the blank line between them counts."""
    rows = [(1, 1, 0, "aaaa"), (1, 1, 1, "bbb"), (1, 2, 0, "c"), (2, 1, 0, "x" * 50), (2, 1, 1, "y"), (3, 1, 0, "")]
    df = spark.createDataFrame(rows, "request_id long, rank int, chunk_no int, chunk string")

    def got(budget):
        return {r.request_id: r.context for r in chain.stuff_context(df, max_chars=budget).collect()}
    assert got(None) == {1: "aaaa\n\nbbb\n\nc", 2: "x" * 50 + "\n\ny", 3: ""}
    assert got(9) == {1: "aaaa\n\nbbb", 3: ""}
    assert got(8) == {1: "aaaa", 3: ""}
    assert got(12) == {1: "aaaa\n\nbbb\n\nc", 3: ""}
    assert got(50) == {1: "aaaa\n\nbbb\n\nc", 2: "x" * 50, 3: ""}
    assert got(0) == {3: ""}
