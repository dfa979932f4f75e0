"""Writes: keyed three-way sync, upserts, stale rows, cascades, partition rewrites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.ranks import numbered_whole


def actions(new: DataFrame, old: DataFrame, keys: list[str], content: str) -> DataFrame:
    """(keys, action): insert, update, skip or delete, by key and content hash."""
    o = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(content).alias("_content"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_{k}"))
    both = new.select(*keys, content, F.lit(1).alias("_new")).join(o.withColumn("_old", F.lit(1)), met, "full")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").when(F.col(content).eqNullSafe(F.col("_content")), "skip").otherwise("update")
    return both.select(*[F.coalesce(k, f"_{k}").alias(k) for k in keys], action.alias("action"))


def action_counts(found: DataFrame, key: str) -> DataFrame:
    """(key, inserted, updated, skipped, deleted)."""
    of = lambda a: F.count_if(F.col("action") == a)
    return found.groupBy(key).agg(of("insert").alias("inserted"), of("update").alias("updated"), of("skip").alias("skipped"), of("delete").alias("deleted"))


def upserted(new: DataFrame, old: DataFrame, key: str, replaced: list[str]) -> DataFrame:
    """New and old rows by key; a new value wins over an old one, and a null one only in `replaced` columns of rows that are new."""
    columns = [c for c in old.columns if c != key]
    n = new.select(F.col(key), *[F.col(c).alias(f"_n_{c}") for c in columns], F.lit(True).alias("_new"))
    both = old.join(n, key, "full")
    pick = lambda c: F.when(F.col("_new") & F.lit(c in replaced), F.col(f"_n_{c}")).otherwise(F.coalesce(f"_n_{c}", c)).alias(c)
    return both.select(key, *map(pick, columns))


def next_ids(rows: DataFrame, stored: DataFrame, order: list[str], id_col: str = "id") -> DataFrame:
    """`rows` with ids that follow the largest stored one, without gaps, in order."""
    top = stored.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top")).scalar()
    return numbered_whole(rows, [F.col(c) for c in order], "_nth").withColumn(id_col, F.col("_nth") + top).drop("_nth")


def stale(stored: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Stored keys that nobody wants any more."""
    return stored.select(*keys).distinct().join(wanted.select(*keys).distinct(), keys, "left_anti")


def cascade_counts(tables: dict[str, DataFrame], book_id: int) -> DataFrame:
    """(store, deleted): how many rows of a book each table would lose."""
    parts = [df.where(F.col("book_id") == book_id).agg(F.count(F.lit(1)).alias("deleted")).select(F.lit(name).alias("store"), "deleted") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def rewrite_partitions(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Replaces exactly the partitions that `rows` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def reset_interrupted(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.withColumn(status, F.when(F.col(status) == "processing", "pending").otherwise(F.col(status)))
