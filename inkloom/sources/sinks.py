"""Writes of books, messages and logs as partitioned tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkloom.operators import sessions, sync


def save_chapters(chapters: DataFrame, path: str) -> None:
    """Replaces the chapters of exactly the books that are given."""
    sync.rewrite_partitions(chapters, path, ["book_id"])


def delete_book(spark: SparkSession, paths: dict[str, str], book_id: int, out: str) -> DataFrame:
    """Writes every table without a book's rows under `out`, and gives how many each lost."""
    tables = {name: spark.read.parquet(path) for name, path in paths.items()}
    for name, df in tables.items():
        df.where(~F.col("book_id").eqNullSafe(F.lit(book_id))).write.mode("overwrite").parquet(f"{out}/{name}")
    return sync.cascade_counts(tables, book_id)


def append_messages(messages: DataFrame, path: str) -> None:
    sessions.sanitised(messages).write.mode("append").parquet(path)


def log_page(query: Column, status: Column, confidence: Column, answer: Column, citations: Column) -> Column:
    """A search's result as a page of Markdown; parts without content are left out."""
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"- {head}: "), c))
    facts = F.concat_ws("\n", line("status", status), line("confidence", confidence.cast("string")), line("citations", F.array_join(citations, ", ")))
    part = lambda head, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"## {head}\n\n"), F.trim(c)))
    return F.concat(F.concat_ws("\n\n", F.concat(F.lit("# "), F.regexp_replace(F.trim(query), "\\s+", " ")), F.nullif(facts, F.lit("")), part("Answer", answer)), F.lit("\n"))


def append_log(results: DataFrame, path: str) -> None:
    """Search results (request_id, query, status, confidence, answer, citations, ...) as JSON lines and as pages of Markdown, a folder for each day."""
    rows = results.withColumn("day", F.current_date())
    rows.write.mode("append").partitionBy("day").json(f"{path}/json")
    page = log_page(*[F.col(c) for c in ("query", "status", "confidence", "answer", "citations")])
    rows.select("day", page.alias("page")).write.mode("append").partitionBy("day").option("lineSep", "\n---\n").text(f"{path}/markdown")
