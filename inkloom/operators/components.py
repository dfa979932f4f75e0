"""Connected components over an edge table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and the master is local."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = folder or "file://" + tempfile.mkdtemp(prefix="spark-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder as Parquet and read again: its size is known to the planner, and columns that nobody asks for aren't read."""
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root): for each node of an edge the smallest node connected with it.

    Labels spread to neighbours and then jump to their label's label, so the rounds grow with the logarithm of a chain's length; minima are aggregated before each shuffle.
    Loops and null nodes are ignored.
    """
    edges = edges.select(F.col(a).alias("s"), F.col(b).alias("t")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = checkpointed(edges.union(edges.select("t", "s")).distinct())
    labels = checkpointed(both.groupBy("s").agg(F.min("t").alias("m")).select(F.col("s").alias("v"), F.least("s", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("v").alias("t"), "root"), "t").groupBy(F.col("s").alias("v")).agg(F.min("root").alias("near"))
        step = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("low"))
        jump = labels.select(F.col("v").alias("low"), F.col("root").alias("far"))
        step = checkpointed(step.join(jump, "low", "left").select("v", F.col("root").alias("old"), F.least("low", "far").alias("root")))
        labels = step.select("v", "root")
        if step.where("old <> root").isEmpty():
            return labels
