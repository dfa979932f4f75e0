"""Training rows from chapters, plots and volumes, and their export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.ranks import numbered_whole, previous

#: The summary that marks a chapter without one, and the length below which a chapter is no training row.
NO_SUMMARY, LEAST_CHARS, TAIL_CHARS = "", 200, 600


def joined(chapters: DataFrame, plots: DataFrame, volumes: DataFrame) -> DataFrame:
    """Chapters with their plot's and volume's rows; chapters without one stay, plots that repeat fan out."""
    p = plots.withColumnsRenamed({"book_id": "_pb", "plot_id": "_pp"})
    v = volumes.withColumnsRenamed({"book_id": "_vb", "volume_id": "_vv"})
    rows = chapters.join(p, (F.col("book_id") == F.col("_pb")) & (F.col("plot_id") == F.col("_pp")), "left")
    return rows.join(v, (F.col("book_id") == F.col("_vb")) & (F.col("volume_id") == F.col("_vv")), "left").drop("_pb", "_pp", "_vb", "_vv")


def usable(rows: DataFrame, least_chars: int = LEAST_CHARS, no_summary: str = NO_SUMMARY) -> DataFrame:
    return rows.where((F.length(F.trim("content")) >= least_chars) & (F.coalesce(F.trim("chapter_summary"), F.lit("")) != "") & (F.col("chapter_summary") != no_summary))


def with_previous_tail(rows: DataFrame, chars: int = TAIL_CHARS) -> DataFrame:
    """`rows` with previous_tail: the last characters of the same book's previous row; empty for the first. Only tails are gathered, by stretches of a book, not texts."""
    tail = F.when(F.length("content") > chars, F.expr(f"right(content, {chars})")).otherwise(F.col("content"))
    found = previous(rows.select("book_id", "chapter_index", tail.alias("_tail")), "book_id", "chapter_index", "_tail", "previous_tail")
    tails = found.select(F.col("book_id").alias("_b"), F.col("chapter_index").alias("_c"), F.coalesce("previous_tail", F.lit("")).alias("previous_tail"))
    return rows.join(tails, F.col("book_id").eqNullSafe(F.col("_b")) & (F.col("chapter_index") == F.col("_c"))).drop("_b", "_c")


def with_prompt(rows: DataFrame) -> DataFrame:
    """`rows` with sample_id and the training prompt; sections without content are left out."""
    section = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"[{title}]\n"), F.col(c)))
    prompt = F.concat_ws("\n\n", F.concat(F.lit("[book]\n"), F.col("book_id").cast("string")), section("volume", "volume_summary"), section("plot", "plot_summary"), section("chapter", "chapter_summary"), section("previous", "previous_tail"))
    return rows.withColumn("sample_id", F.concat(F.col("book_id").cast("string"), F.lit(":"), F.col("chapter_index").cast("string"))).withColumn("prompt", prompt)


def export(rows: DataFrame, path: str) -> None:
    """JSON lines, a folder for each split: raw rows, and chat messages."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/raw")
    messages = rows.select("split", "sample_id", F.array(turn("system", F.lit("")), turn("user", F.col("prompt")), turn("assistant", F.col("content"))).alias("messages"))
    messages.write.mode("overwrite").partitionBy("split").json(f"{path}/messages")
    manifest = rows.groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("book_id").alias("books"))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def checked_split(available: DataFrame, train: DataFrame, validation: DataFrame) -> DataFrame:
    """(book_id, split, fault) of given lists of books: unknown ones, and those in both lists, are faults."""
    known = available.select("book_id").distinct().withColumn("_known", F.lit(True))
    both = train.select("book_id", F.lit("train").alias("split")).unionByName(validation.select("book_id", F.lit("validation").alias("split"))).distinct()
    twice = both.groupBy("book_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = both.join(twice, "book_id").join(known, "book_id", "left")
    fault = F.when(F.col("_known").isNull(), "unknown book").when(F.col("_n") > 1, "in both lists")
    return rows.select("book_id", "split", fault.alias("fault"))


def book_split(books: DataFrame, ratio: float = 0.25, seed: int = 7) -> DataFrame:
    """(book_id, split): whole books; the share `ratio` (one at least if there are two books) with the smallest seeded hash validates."""
    names = books.select("book_id").distinct()
    luck = F.md5(F.concat_ws(":", F.col("book_id").cast("string"), F.lit(str(seed))))
    rows = numbered_whole(names.withColumn("_luck", luck), [F.col("_luck"), F.col("book_id")], "_n").withColumn("_all", names.agg(F.count(F.lit(1))).scalar())
    held = F.when(F.col("_all") < 2, 0).otherwise(F.greatest(F.lit(1), F.bround(F.col("_all") * ratio)))
    return rows.select("book_id", F.when(F.col("_n") <= held, "validation").otherwise("train").alias("split"))
