"""Stored vectors kept in step with their texts: only what has changed is embedded again, upload by upload or as a stream.

Points lie in a store with the hash of the model and text that their vector was made of; a row whose point has its hash is passed over. What a batch changes is one version of the store, with the stream's batch number in it, so a
batch that comes again after a failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from inkloom.functions.keys import embedding_hash, point_id
from inkloom.models import Embedder, hashed_embedding
from inkloom.operators.components import written
from inkloom.operators.states import checked_vectors
from inkloom.sources.stored import Store

#: How many texts go to a service at a time.
BATCH = 128


def batched(service: Callable[[list[str]], list[list[float]]], size: int = BATCH) -> Callable[[DataFrame], DataFrame]:
    """A service that embeds lists of texts, as a function of rows (text, ...) that adds their vectors; it gets `size` texts at most at a time, and as many vectors must come back."""

    def run(pages: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for page in pages:
            for start in range(0, len(page), size):
                part = page.iloc[start : start + size]
                vectors = service(part["text"].tolist())
                if len(vectors) != len(part):
                    raise RuntimeError(f"{len(vectors)} vectors for {len(part)} texts")
                yield part.assign(vector=vectors)

    return lambda rows: rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", vector array<float>")


def by_column(embed: Embedder) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("vector", embed(F.col("text")).cast("array<float>"))


def stable_id(collection: str, *parts: Column) -> Column:
    """A point's number, the same whenever it is made of the same parts."""
    return point_id(F.concat_ws("|", F.lit(collection), *[p.cast("string") for p in parts]))


def sync(store: Store, rows: DataFrame, collection: str = "chapters", vectors: Callable[[DataFrame], DataFrame] | None = None, model: str = "hashed-64", size: int = 64, reset: bool = False, batch: int | None = None) -> dict[str, int] | None:
    """Brings the points of the books of `rows` (book_id, source_id, text) in step; what it did: embedded, skipped, deleted. None if the batch was there before.

    Rows without a text get no vector and count as not wanted. With `reset`, points of these books that no row wants go; without it they stay. A store keeps the size of its vectors: another one is refused.
    """
    change = store.begin()
    stamp = f"{collection}:batch"
    if batch is not None and change.notes().get(stamp, -1) >= batch:
        return None
    if change.notes().get(f"{collection}:size", size) != size:
        raise ValueError(f"{collection} has vectors of {change.notes()[f'{collection}:size']} numbers, not of {size}")
    clean = F.trim(F.coalesce("text", F.lit("")))
    given = rows.select("book_id", "source_id", clean.alias("text")).dropDuplicates(["book_id", "source_id"])
    wanted = written(given.where("text <> ''").select(stable_id(collection, F.col("book_id"), F.col("source_id")).alias("id"), "book_id", "source_id", "text", embedding_hash(model, F.col("text")).alias("hash")))
    stored = change.read(collection)
    known = rows.sparkSession.createDataFrame([], "id bigint, book_id bigint, hash string") if stored is None else stored.select("id", "book_id", "hash")
    fresh = written(wanted.join(known.select(F.col("id").alias("_i"), F.col("hash").alias("_h")), (F.col("id") == F.col("_i")) & (F.col("hash") == F.col("_h")), "left_anti"))
    mine = known.join(given.select("book_id").distinct(), "book_id", "left_semi")
    stale = written(mine.join(wanted.select("id"), "id", "left_anti").select("book_id", "id")) if reset else known.select("book_id", "id").limit(0)
    embedded, deleted, total = fresh.count(), stale.count(), wanted.count()
    if embedded or deleted:
        points = checked_vectors((vectors or by_column(hashed_embedding(size)))(fresh), size)
        change.exchange(collection, points.select("id", "book_id", "source_id", "hash", "vector"), stale, ["book_id", "id"])
    change.note(f"{collection}:size", size)
    if batch is not None:
        change.note(stamp, batch)
    change.commit()
    return {"embedded": embedded, "skipped": total - embedded, "deleted": deleted}


def follow(stream: DataFrame, store: Store, checkpoint: str, **how) -> StreamingQuery:
    """Keeps a store's vectors in step with a stream of uploaded rows (book_id, source_id, text); what each batch did is in the query's store."""

    def step(rows: DataFrame, number: int) -> None:
        sync(store, rows, batch=number, **how)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
