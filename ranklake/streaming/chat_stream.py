"""Chat messages as a Structured Streaming job.

* ``chat_source``: ``readStream`` over JSON text lines, parsed with
  ``from_json`` (the same expression as the batch parse).
* ``answer_messages``: the batch plan for one set of messages: route,
  caption query, search (retriever defaults), chunks, sources, links and
  the answer markup. Used on tables and inside ``foreachBatch``.
* ``stream_search``: ``foreachBatch`` around ``answer_messages`` because
  ranking windows are not allowed on a stream; every micro-batch overwrites
  its own ``batch_id=`` folder, so a replay after a failure writes the same
  rows again (at-least-once delivery, idempotent output). Progress lives in
  a checkpoint folder under the shared ``spark.checkpoint.dir``.
* ``stream_memory``: last-k memory per conversation as streaming state
  (``applyInPandasWithState``); the state holds at most 2k messages per
  conversation.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ranklake.config import MEMORY_EXCHANGES, RETRIEVER_LANG, RETRIEVER_LIMIT
from ranklake.operators import chain, chat
from ranklake.operators.postings import SearchIndex
from ranklake.plans.search import search


@dataclass
class ChatConfig:
    """The retriever's parameters (the chain's defaults: language ``en``,
    limit 100); ``index`` names the index the chat searches."""

    index: str
    lang: str | None = RETRIEVER_LANG
    limit: int = RETRIEVER_LIMIT


def chat_source(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return chat.parse_messages(reader.load(path))


def answer_messages(messages: DataFrame, index: SearchIndex, metadata: DataFrame | None,
                    cfg: ChatConfig, captions: DataFrame, answers: DataFrame,
                    mapping: DataFrame | None = None,
                    records: DataFrame | None = None) -> DataFrame:
    """messages(message_id, username, message, role, ...) -> one answer row
    per user message: (message_id, sources, context, html).

    ``answers(message_id, answer)`` stands in for the language model; a
    message without an answer row gets an empty answer."""
    user = chat.message_router(messages.filter(F.col("role") == "user"))
    queries = chat.caption_query(user, captions)
    reqs = queries.select(
        F.col("message_id").alias("request_id"), F.col("query").alias("q"),
        F.lit(cfg.index).alias("index"), F.lit(cfg.lang).cast("string").alias("lang"),
        F.lit(None).cast("string").alias("ranking"), F.lit(cfg.limit).cast("int").alias("limit"))
    # A record is a result of many messages: its snippet is cut once.
    out = search(reqs, index, metadata, cfg.index, mapping=mapping, records=records,
                 record_fields={"chunks": chain.chunk_text("textSnippet")})
    chunks = chain.explode_chunks(out.results, "chunks", ["request_id", "rank", "url"], chunked=True) \
        .withColumnRenamed("url", "source")
    both = chain.context_and_sources(chunks)
    empty = F.array().cast("array<string>")
    rows = (queries.select(F.col("message_id").alias("request_id"))
            .join(both, "request_id", "left")
            .join(answers.withColumnRenamed("message_id", "request_id"), "request_id", "left"))
    links = chain.reference_links(F.coalesce(F.col("shown"), empty))
    return rows.select(
        F.col("request_id").alias("message_id"),
        F.coalesce(F.col("sources"), empty).alias("sources"),
        F.coalesce(F.col("context"), F.lit("")).alias("context"),
        chain.answer_html(F.coalesce(F.col("answer"), F.lit("")), links).alias("html"))


def transcript_batch(messages: DataFrame, index: SearchIndex, metadata: DataFrame | None,
                     cfg: ChatConfig, captions: DataFrame, answers: DataFrame,
                     mapping: DataFrame | None = None,
                     records: DataFrame | None = None) -> DataFrame:
    """Batch form of the stream: echoed user rows and ``ai`` rows."""
    ans = answer_messages(messages, index, metadata, cfg, captions, answers, mapping, records)
    user = messages.filter(F.col("role") == "user")
    return chat.transcript(user, ans)


def stream_search(stream: DataFrame, index: SearchIndex, metadata: DataFrame | None,
                  cfg: ChatConfig, captions: DataFrame, answers: DataFrame,
                  sink: str, checkpoint: str | None = None, available_now: bool = True,
                  mapping: DataFrame | None = None, records: DataFrame | None = None):
    """Start the streaming job; returns the ``StreamingQuery``.

    Progress lives in ``checkpoint``, by default the folder next to ``sink``
    with the suffix ``.checkpoint``, so a restart on the same sink goes on
    where it ended. A micro-batch is read once and held while it is answered."""
    checkpoint = checkpoint or f"{sink.rstrip('/')}.checkpoint"

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            out = transcript_batch(batch, index, metadata, cfg, captions, answers, mapping, records)
            out.write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    w = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


#: A conversation without a message for so long is forgotten (a day).
MEMORY_IDLE_MS = 24 * 3600 * 1000

MEMORY_OUT = T.StructType([
    T.StructField("conv_id", T.LongType()),
    T.StructField("emit", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("text", T.StringType()),
])
MEMORY_STATE = T.StructType([
    T.StructField("emits", T.LongType()),
    T.StructField("turns", T.ArrayType(T.LongType())),
    T.StructField("roles", T.ArrayType(T.StringType())),
    T.StructField("texts", T.ArrayType(T.StringType())),
])


def _memory_fn(k: int, idle_ms: int | None):
    keep = 2 * k

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        emits, held = 0, {}
        if state.exists:
            emits, turns, roles, texts = state.get
            held = {t: (r, x) for t, r, x in zip(turns, roles, texts, strict=True)}
        for pdf in batches:  # a conversation may come in several pieces
            for t, r, x in zip(pdf["turn"], pdf["role"], pdf["text"], strict=True):
                held[int(t)] = (r, x)  # a turn that comes again replaces itself
            held = {t: held[t] for t in sorted(held)[-keep:]}
        emits += 1
        turns = list(held)
        roles, texts = [held[t][0] for t in turns], [held[t][1] for t in turns]
        state.update((emits, turns, roles, texts))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"conv_id": [key[0]] * len(turns), "emit": [emits] * len(turns),
                            "turn": turns, "role": roles, "text": texts})

    return update


def stream_memory(stream: DataFrame, k: int = MEMORY_EXCHANGES,
                  idle_ms: int | None = MEMORY_IDLE_MS) -> DataFrame:
    """Streaming last-k memory: after every micro-batch, the conversation's
    current memory (at most 2k user/assistant messages) tagged with the
    emission number.

    State and input are merged by turn before they are cut, so late and
    repeated messages and any split into micro-batches give the same memory.
    The state per conversation is bounded by 2k messages and removed after
    ``idle_ms`` without one; messages without conversation or turn are left
    out. A query that ends by itself (``availableNow``) must pass None: with a
    timeout Spark goes on running empty batches to look for idle states."""
    m = stream.filter(F.col("role").isin("user", "assistant") & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id", "turn", "role", F.col("message").alias("text"))
    return m.groupBy("conv_id").applyInPandasWithState(
        _memory_fn(k, idle_ms), MEMORY_OUT, MEMORY_STATE, "append",
        GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)
