"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import checkpointed


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): for every node of an edge, the smallest node that it is connected with.

    Each round replaces the edges: every node's larger neighbours (large star), then every node with its smaller ones (small star), are
    tied to the smallest of its neighbourhood. The count of edges never grows beyond the input's, minima are aggregated before the shuffle,
    and the rounds end when nothing changes (about log n of them). Each round is checkpointed to the shared folder.
    Loops are ignored; null nodes are ignored; an empty table gives an empty table.
    """
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    now, before = checkpointed(now), None
    while True:
        both = now.select("u", "v").union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("c")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), "m")
        small = large.join(low, F.col("u") == F.col("c"))
        now = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        # A forest of stars no longer changes: its edge sum and count stay.
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before:
            break
        before = size
    return now.select(F.col("u").alias("v"), F.col("v").alias("root")).union(now.select("v", F.col("v").alias("root")).distinct())
