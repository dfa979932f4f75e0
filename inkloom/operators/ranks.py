"""Row numbers and running sums of keys that may hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.components import checkpointed


def numbered(df: DataFrame, key: str, order: str, name: str, width: int = 4096) -> DataFrame:
    """Adds `name`: the row's number (from 1) among its key's rows by the integer column `order`.

    A key's rows meet only in stretches of `width` order values, whose counts are aggregated before the shuffle; the counts' running sums make the stretches' first
    numbers. Rows of equal order are numbered in any order; null orders come first.
    """
    part = F.coalesce(F.floor(F.col(order) / width), F.lit(-(1 << 62)))
    df = df.withColumn("_part", part)
    counts = df.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(key).alias("_k"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(key, "_part").orderBy(order))
    out = df.withColumn("_inside", inside).join(counts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_k", "_p", "_base", "_inside")


def previous(df: DataFrame, key: str, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """Adds `name`: `value` of the key's row before by the integer column `order`, which no two of its rows share; null for the first.

    Rows meet in stretches of `width` order values only; a stretch's first row gets the last value of the nearest stretch before that has any, and these last values are few.
    """
    df = df.withColumn("_part", F.floor(F.col(order) / width))
    ends = df.groupBy(F.col(key).alias("_k"), F.col("_part").alias("_p")).agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_end"))
    ends = ends.select("_k", "_p", F.lag("_end").over(Window.partitionBy("_k").orderBy("_p")).alias("_before"))
    inside = F.lag(F.struct(F.col(value).alias("v"))).over(Window.partitionBy(key, "_part").orderBy(order))
    out = df.withColumn("_inside", inside).join(ends, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, F.coalesce("_inside", "_before")["v"]).drop("_part", "_k", "_p", "_before", "_inside")


def numbered_whole(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds `name`: the row's number (from 1) among all rows by `order`. Rows are dealt over ranges of the order; only the ranges' counts are added up in one place."""
    dealt = checkpointed(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = dealt.withColumn("_inside", inside).join(counts, F.col("_part") == F.col("_p"))
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop("_part", "_p", "_base", "_inside")


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], most: int, name: str = "rank") -> DataFrame:
    """The first `most` rows of each key by `order`, numbered. Spark keeps `most` rows of each key before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= most)
