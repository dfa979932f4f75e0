"""Structured Streaming: sessions by gap, and a stateful trigger for summaries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read(spark: SparkSession, path: str, pattern: str = "events.parquet", schema: str = SCHEMA) -> DataFrame:
    """The event files under a path as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, started, ended, n, total): events of a user that follow each other within the gap; later events than `late` are not waited for."""
    by = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n", "total")


def due(events: DataFrame, more_than: int = 10) -> DataFrame:
    """(user_id, upto, n): a row whenever a user has more than that many events since the last row; the count is kept as state.

    A run's events of a user come in several parts and in any order. They count by event_id, so their ids, and nothing else of them, are held and sorted together.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else 0
        ids = np.sort(np.concatenate([pdf["event_id"].to_numpy() for pdf in batches]))
        upto = ids[more_than - held :: more_than + 1]
        state.update(((held + len(ids)) % (more_than + 1),))
        yield pd.DataFrame({"user_id": key[0], "upto": upto, "n": more_than + 1})

    return events.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, "user_id bigint, upto bigint, n bigint", "held bigint", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over all that is there and writes it as Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
