"""Streamed conversation memory with resets (``transformWithStateInPandas``).

A reset forgets all turns up to its own. The state of a conversation is the
turn of its last reset and the last 2k messages behind it, so messages that come
late, from before a reset, are refused, whatever the micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ranklake.config import MEMORY_EXCHANGES
from ranklake.session import ship_package

OUT = "conv_id long, emit long, turn long, role string, text string"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ResetMemory(StatefulProcessor):
    """``held``: turn -> message; ``marks``: emissions so far, last reset."""

    def __init__(self, k: int, idle_ms: int | None):
        self.keep, self.idle_ms = 2 * k, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "turn long", "role string, text string", ttlDurationMs=self.idle_ms)
        self.marks = handle.getValueState("marks", "emits long, reset long", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        emits, reset = self.marks.get() if self.marks.exists() else (0, None)
        held = {t[0]: tuple(v) for t, v in self.held.iterator()} if self.held.exists() else {}
        before = set(held)
        for pdf in rows:
            resets = pdf.loc[pdf["is_reset"], "turn"]
            if len(resets):
                reset = max(int(resets.max()), -1 << 63 if reset is None else reset)
            for t, r, x, is_reset in zip(pdf["turn"], pdf["role"], pdf["text"], pdf["is_reset"], strict=True):
                if not is_reset and (reset is None or t > reset):
                    held[int(t)] = (r, x)
            behind = sorted(t for t in held if reset is None or t > reset)
            held = {t: held[t] for t in behind[-self.keep:]}
        emits += 1
        self.marks.update((emits, reset))
        for t in before - set(held):
            self.held.removeKey((t,))
        for t, message in held.items():
            self.held.updateValue((t,), message)
        shown = [(key[0], emits, t, r, x) for t, (r, x) in held.items()] or [(key[0], emits, None, None, None)]
        out = pd.DataFrame(shown, columns=["conv_id", "emit", "turn", "role", "text"])
        yield out.astype({"turn": "Int64"})

    def close(self) -> None:
        pass


def stream_memory_reset(stream: DataFrame, k: int = MEMORY_EXCHANGES, idle_ms: int | None = None) -> DataFrame:
    """(conv_id, emit, turn, role, text): after every micro-batch the memory of
    the conversations in it, tagged with the number of the emission; one row
    with a null turn where a reset left nothing.

    ``stream`` has conv_id, turn, role, message and ``is_reset``. Messages of
    other roles that are no resets, and rows without conversation or turn, are
    left out; a null ``is_reset`` is no reset; a turn that comes again replaces
    itself. State expires ``idle_ms`` after it was last written; a query that
    ends by itself must pass None, as with ``stream_memory``. The session's
    state store must be RocksDB (``use_rocksdb``)."""
    ship_package(stream.sparkSession)
    is_reset = F.coalesce(F.col("is_reset"), F.lit(False))
    m = (stream.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
         .filter(is_reset | F.col("role").isin("user", "assistant"))
         .select("conv_id", "turn", "role", F.col("message").alias("text"), is_reset.alias("is_reset")))
    return m.groupBy("conv_id").transformWithStateInPandas(
        ResetMemory(k, idle_ms), OUT, "append", "none" if idle_ms is None else "processingTime")


def use_rocksdb(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
