"""Chat messages: routing, image payload, caption query, transcript rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ranklake.config import CAPTION_PREFIX, IMAGE_PREFIX

MESSAGE_SCHEMA = T.StructType([
    T.StructField("message", T.StringType()),
    T.StructField("username", T.StringType()),
    T.StructField("conv_id", T.LongType()),
    T.StructField("turn", T.LongType()),
    T.StructField("role", T.StringType()),
    T.StructField("message_id", T.StringType()),
])


def parse_messages(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """JSON text lines ``{message, username, ...}`` -> columns (batch or
    streaming; the same expression)."""
    return lines.select(F.from_json(F.col(value_col), MESSAGE_SCHEMA).alias("m")).select("m.*")


def message_router(messages: DataFrame, col: str = "message") -> DataFrame:
    """``image`` when the message starts with the JPEG data-URL prefix,
    ``text`` otherwise (a PNG data URL is text)."""
    return messages.withColumn(
        "route", F.when(F.col(col).startswith(IMAGE_PREFIX), F.lit("image")).otherwise(F.lit("text")))


def image_payload(messages: DataFrame, col: str = "message") -> DataFrame:
    """Bytes of an image message: the second comma-separated piece,
    base64-decoded; undecodable input gives NULL rather than junk."""
    piece = F.try_element_at(F.split(F.col(col), ",", -1), F.lit(2))
    payload = F.when(F.col(col).contains(","), piece).otherwise(F.col(col))
    return messages.withColumn("payload", F.try_to_binary(payload, F.lit("base64")))


def caption_query(routed: DataFrame, captions: DataFrame, col: str = "message") -> DataFrame:
    """Query text per message: ``tell me about <caption>`` for images (the
    caption comes from a captions table), the message itself for text."""
    j = routed.join(captions.select("message_id", "caption"), "message_id", "left")
    q = F.when(F.col("route") == "image",
               F.when(F.col("caption").isNotNull(),
                      F.concat(F.lit(CAPTION_PREFIX), F.col("caption"))))
    return j.withColumn("query", F.coalesce(q, F.when(F.col("route") == "text", F.col(col)))) \
        .drop("caption")


def transcript(messages: DataFrame, answers: DataFrame) -> DataFrame:
    """The user's message echoed (seq 0) and the ``ai`` reply (seq 1).
    answers(message_id, html)."""
    user = messages.select("message_id", F.lit(0).alias("seq"), "username",
                           F.col("message").alias("text"))
    ai = answers.select("message_id", F.lit(1).alias("seq"), F.lit("ai").alias("username"),
                        F.col("html").alias("text"))
    return user.unionByName(ai)
