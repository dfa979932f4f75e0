"""Sharding by longest-processing-time scheduling, with groups that stay together.

Groups (rows of equal text) are scheduled largest first: each goes to the shard with the least so far, which a heap finds. A heap takes
one step after another, so what it schedules is bounded: a group larger than a small share of a shard is an item of its own, all smaller ones
are bundled by their key's hash, and the bundles are items. There are at most `per_shard` large groups and `per_shard` bundles for each shard, whatever the
number of groups, and a bundle is a small share of a shard's size. The sums that make the items are aggregated before the shuffle.

Laws: `bytes` makes the shards' sizes near equal; `rows` deals single rows so that counts are at most one apart; `key` places a row by
its id and the shard count alone (jump hash), so that one more shard takes rows only into itself. Only `bytes` schedules, and only it keeps groups together
by what they hold; `key` keeps rows of one id together.

What bounds a task's memory: the one task with the heap holds 2 * shards * per_shard items at most; all others hold one text, whose hash and size are taken where it lies, or a bucket of numbers.

Defined cases: a null text is empty (size 16) and a group with empty texts; very long texts count whole; ties of size go in the order of the items' names and to the lowest shard, and slots are
numbered by id and then by the text's hash; repeated rows get slots of their own; a group larger than a shard is a
shard's alone; with fewer groups than shards some shards stay empty; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import checkpointed, running_sum

OVERHEAD = 16
SLOT_BUCKETS = 256


def least_loaded(sizes: list[int], shards: int) -> list[int]:
    """The shard of each item: largest first, to the shard with the least so far (ties: the lowest shard)."""
    heap = [(0, s) for s in range(shards)]
    out = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        load, s = heapq.heappop(heap)
        out[i] = s
        heapq.heappush(heap, (load + sizes[i], s))
    return out


def by_bytes(rows: DataFrame, shards: int, per_shard: int = 200) -> DataFrame:
    """`rows` (key, size, ...) with `shard`; rows of one key stay together."""
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"))
    total = groups.agg(F.sum("size")).first()[0] or 0
    large = F.col("size") > total / (shards * per_shard)
    bundle = F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(shards * per_shard)))
    groups = checkpointed(groups.select("key", "size", F.when(large, F.concat(F.lit("g"), F.col("key"))).otherwise(bundle).alias("item")))
    items = groups.groupBy("item").agg(F.sum("size").alias("size"))

    def schedule(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", ignore_index=True)
        return pd.DataFrame({"_item": pdf["item"], "shard": least_loaded(pdf["size"].tolist(), shards)})

    # One task holds 2 * shards * per_shard items at most.
    placed = checkpointed(items.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(schedule, "_item string, shard int"))
    key_shard = groups.join(placed, F.col("item") == F.col("_item")).select(F.col("key").alias("_key"), "shard")
    return rows.join(key_shard, F.col("key") == F.col("_key")).drop("_key")


def by_rows(rows: DataFrame, shards: int) -> DataFrame:
    """`rows` (key, id, size, ...) with `shard`: row number in hash order, modulo the shards."""
    rows = rows.withColumn("_all", F.lit(0)).withColumn("_h", F.xxhash64("id", "key")).withColumn("_part", F.shiftright("_h", 48))
    rows = running_sum(rows, "_all", "_part", [F.col("_h"), F.col("id"), F.col("key")], F.lit(1), "_n")
    return rows.withColumn("shard", (F.col("_n") % shards).cast("int")).drop("_all", "_h", "_part", "_n")


def jump(key: Column, shards: int) -> Column:
    """The shard of a key by jump hash: the last shard count at which the key moves. Each step's chance comes from a hash of key and count."""
    moves = F.sequence(F.lit(1), F.lit(shards - 1)) if shards > 1 else F.array().cast("array<int>")
    unit = lambda k: F.xxhash64(key, k) / F.lit(2.0**64) + 0.5
    return F.coalesce(F.array_max(F.filter(moves, lambda k: unit(k) * (k + 1) < 1)), F.lit(0)).cast("int")


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, law: str = "bytes") -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard) of every row; slots are gapless from 0 in each shard."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("key"), (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = checkpointed(rows)
    grown = F.lit(None).cast("int")
    if law == "bytes":
        placed = by_bytes(rows, shards)
    elif law == "rows":
        placed = by_rows(rows, shards)
    elif law == "key":
        placed, grown = rows.withColumn("shard", jump(F.col("id"), shards)), jump(F.col("id"), shards + 1)
    else:
        raise ValueError(f"no such law: {law}")
    # A shard's rows are numbered bucket by bucket: a group of copies spreads over the buckets by its rows' ids.
    placed = placed.withColumn("_bucket", F.pmod(F.xxhash64("id", F.lit("slot")), F.lit(SLOT_BUCKETS)))
    placed = running_sum(placed, "shard", "_bucket", [F.col("id"), F.col("key")], F.lit(1), "slot")
    return placed.select("id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), grown.alias("grown_shard"))


def op5_shard_documents(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal size."""
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
