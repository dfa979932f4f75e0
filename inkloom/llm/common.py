"""What the operators of this subpackage share: words, the shared folder, checkpoints, split running sums."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs without ASCII white space; Python's bytes.split() cuts at the same six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder as Parquet: unlike a checkpoint its columns can be pruned and its size is known to the planner."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running_sum(df: DataFrame, key: str, bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`: the sum of `value` over earlier rows of the same key, where rows are ordered by bucket and then by `order`.

    A key's rows meet only bucket by bucket: the buckets' sums are aggregated before the shuffle, and their own running sum
    has one row for each key and bucket. So a key that holds most rows is spread over its buckets.
    """
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_in_bucket"))
    before = Window.partitionBy(key).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_k"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_in_bucket").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.join(sums, out[key].eqNullSafe(sums["_k"]) & out[bucket].eqNullSafe(sums["_b"]))
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop("_k", "_b", "_base", "_inside")
