"""Streaming: the streamed transcript equals the batch form, the streamed
memory equals the batch window."""

from ranklake.operators import chain
from ranklake.plans import catalog
from ranklake.sources import fixtures as fx


def test_stream_equals_batch(spark, sf):
    streamed = sorted(tuple(r) for r in catalog.q_stream_search(spark, sf).collect())
    batch = sorted(tuple(r) for r in catalog.q_stream_transcript(spark, sf).collect())
    assert streamed == batch and len(batch) > 0


def test_stream_memory_equals_window(spark, sf):
    got = sorted(tuple(r) for r in catalog.q_stream_memory(spark, sf).collect())
    conv = fx.read_table(spark, sf, "conversations")
    exp = sorted(tuple(r) for r in chain.memory_window(conv).select("conv_id", "turn", "role").collect())
    assert got == exp


class State:
    """One conversation's streaming state, in memory."""

    def __init__(self):
        self.held, self.hasTimedOut, self.timeout = None, False, None

    exists = property(lambda self: self.held is not None)
    get = property(lambda self: self.held)

    def update(self, value):
        self.held = value

    def remove(self):
        self.held = None

    def setTimeoutDuration(self, ms):
        self.timeout = ms


def test_memory_merges_late_and_repeated_turns():
    import pandas as pd

    from ranklake.streaming.chat_stream import _memory_fn
    frame = lambda *turns: pd.DataFrame({"turn": turns, "role": ["user"] * len(turns), "text": [f"t{t}" for t in turns]})
    update, state = _memory_fn(1, 1000), State()
    turns = lambda batches: [p["turn"].tolist() for p in update((7,), iter(batches), state)]
    assert turns([frame(4, 5)]) == [[4, 5]]
    assert turns([frame(0, 1)]) == [[4, 5]]
    assert turns([frame(5, 5), frame(6)]) == [[5, 6]]
    assert turns([frame(9), frame(8)]) == [[8, 9]]
    assert state.timeout == 1000
    state.hasTimedOut = True
    assert turns([]) == [] and not state.exists


def test_stream_memory_reset_equals_batch(spark, sf):
    """Several micro-batches with late and repeated turns and resets."""
    from pyspark.sql import functions as F
    got = sorted(tuple(r) for r in catalog.q_stream_memory_reset(spark, sf).collect())
    conv = fx.read_table(spark, sf, "conversations").withColumn("is_reset", F.col("role") == "system")
    exp = sorted(tuple(r) for r in chain.memory_reset(conv).select("conv_id", "turn", "role").collect())
    assert got == exp and exp


def test_late_messages_before_a_reset_are_refused(spark, tmp_path):
    """Micro-batch by micro-batch: a reset forgets, late messages from before it
    stay out, a late reset forgets only what is before it."""
    import json

    from ranklake.streaming.chat_stream import chat_source
    from ranklake.streaming.memory import stream_memory_reset, use_rocksdb
    use_rocksdb(spark)
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()

    def messages(n, *turns):
        lines = [json.dumps({"message_id": f"{c}-{t}", "conv_id": c, "turn": t, "role": r, "username": "u", "message": f"m{t}"}) for c, t, r in turns]
        (source / f"{n}.json").write_text("\n".join(lines))
        stream = chat_source(spark, str(source))
        stream = stream.withColumn("is_reset", stream.role == "system")
        (stream_memory_reset(stream, k=1).writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination())
        out = spark.read.parquet(sink).filter("conv_id = 1").collect()
        last = max(r.emit for r in out)
        return sorted(r.turn for r in out if r.emit == last and r.turn is not None)
    assert messages(1, (1, 0, "user"), (1, 1, "assistant"), (1, 2, "user"), (2, 0, "user"), (None, 5, "user")) == [1, 2]
    assert messages(2, (1, 5, "system")) == []
    assert messages(3, (1, 3, "user"), (1, 4, "assistant")) == []
    assert messages(4, (1, 6, "user"), (1, 8, "user"), (1, 7, "assistant")) == [7, 8]
    assert messages(5, (1, 7, "system")) == [8]
    assert messages(6, (1, 6, "system"), (1, 7, "assistant")) == [8]
