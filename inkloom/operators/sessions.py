"""Sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(messages: DataFrame, most: int = 60) -> DataFrame:
    """The latest messages of each session."""
    return messages.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("message_id")))).where(F.col("_n") <= most).drop("_n")


def after(messages: DataFrame, watermarks: DataFrame) -> DataFrame:
    """The messages after each session's watermark (session_id, last_id); sessions without one give all."""
    w = watermarks.select(F.col("session_id").alias("_s"), F.col("last_id").alias("_w"))
    return messages.join(w, F.col("session_id") == F.col("_s"), "left").where(F.col("message_id") > F.coalesce("_w", F.lit(-1))).drop("_s", "_w")


def summary_due(messages: DataFrame, watermarks: DataFrame, more_than: int = 10) -> DataFrame:
    """(session_id, new_messages, latest_id) of the sessions with more new messages than that."""
    return after(messages, watermarks).groupBy("session_id").agg(F.count(F.lit(1)).alias("new_messages"), F.max("message_id").alias("latest_id")).where(F.col("new_messages") > more_than)


def metrics(messages: DataFrame) -> DataFrame:
    """(session_id, calls, input_tokens, output_tokens)."""
    tokens = lambda role: F.sum(F.when(F.col("role") == role, F.col("token_count")).otherwise(0))
    return messages.groupBy("session_id").agg(F.count_if(F.col("role") == "assistant").alias("calls"), tokens("user").alias("input_tokens"), tokens("assistant").alias("output_tokens"))


def sanitised(messages: DataFrame) -> DataFrame:
    """Roles are user, assistant or system (user for others), token counts are not negative."""
    role = F.when(F.col("role").isin("user", "assistant", "system"), F.col("role")).otherwise("user")
    return messages.withColumn("role", role).withColumn("token_count", F.greatest(F.lit(0), F.coalesce("token_count", F.lit(0))))


def page(rows: DataFrame, order: list, number: int, size: int = 10) -> DataFrame:
    """A page of rows; the number is held within the pages there are. Every task sends the rows up to the page's end at most."""
    pages = max(1, -(-rows.count() // size))
    return rows.orderBy(*order).offset((max(1, min(number, pages)) - 1) * size).limit(size)
