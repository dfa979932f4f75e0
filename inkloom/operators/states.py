"""States of jobs, chapters and plots, and partial syncs, as tables of changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states in which a job has begun and in which it has ended.
BEGUN, ENDED = ("running", "completed", "error", "cached"), ("completed", "error", "cached")


def created_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """New jobs (status) with started_at and finished_at as far as their state has them."""
    return jobs.withColumn("started_at", F.when(F.col("status").isin(*BEGUN), now)).withColumn("finished_at", F.when(F.col("status").isin(*ENDED), now))


def updated_jobs(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Jobs (job_id, status, started_at, finished_at, error) after changes (job_id, new_status, message): the start is set once, by running; the end by every state that ends."""
    c = changes.select(F.col("job_id").alias("_j"), "new_status", "message")
    rows = jobs.join(c, F.col("job_id") == F.col("_j"), "left")
    hit = F.col("_j").isNotNull()
    started = F.when(F.col("started_at").isNull() & (F.col("new_status") == "running"), now).otherwise(F.col("started_at"))
    finished = F.when(F.col("new_status").isin(*ENDED), now).otherwise(F.col("finished_at"))
    error = F.when(hit, F.nullif("message", F.lit(""))).otherwise(F.col("error"))
    return rows.select("job_id", F.coalesce("new_status", "status").alias("status"), started.alias("started_at"), finished.alias("finished_at"), error.alias("error"))


def chapter_status(status: Column, title: Column, summary: Column, payload: Column) -> Column:
    """A chapter's missing state, from what it holds."""
    found = F.when(F.lower(F.coalesce(title, F.lit(""))) == "error", "error").when((F.coalesce(summary, F.lit("")) != "") & payload.isNotNull(), "success")
    return F.coalesce(status, found)


def step_status(status: Column, error: Column, done: Column) -> Column:
    """A plot's step that is pending (or has no state) without an error is a success if its result is there."""
    open_ = (F.coalesce(status, F.lit("")) == "") | (status == "pending")
    return F.when(open_ & (F.coalesce(error, F.lit("")) == "") & done, "success").otherwise(status)


def retries(plots: DataFrame, exhausted: bool = False, most: int = 10) -> DataFrame:
    """Plots (status, retry_count) in error that may be tried again, or those that may not any more."""
    n = F.coalesce("retry_count", F.lit(0))
    return plots.where((F.col("status") == "error") & ((n >= most) if exhausted else (n < most)))


def limited_sync(wanted: DataFrame, stored: DataFrame, row_limit: int | None = None, skip_existing: bool = False) -> DataFrame:
    """(id, action) of points (id, hash): as sync does, but with a limit only the first rows (by id) are looked at and nothing is deleted; with skip_existing a store that holds anything is left alone."""
    rows = wanted.orderBy("id").limit(row_limit) if row_limit is not None else wanted
    s = stored.select(F.col("id").alias("_id"), F.col("hash").alias("_h"))
    both = rows.join(s, F.col("id") == F.col("_id"), "left" if row_limit is not None else "full")
    action = F.when(F.col("id").isNull(), "delete").when(F.col("_id").isNull(), "insert").when(F.col("hash").eqNullSafe(F.col("_h")), "skip").otherwise("update")
    found = both.select(F.coalesce("id", "_id").alias("id"), action.alias("action"))
    if not skip_existing:
        return found
    held = stored.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.where(~((held > 0) & (F.col("action") == "delete"))).withColumn("action", F.when(held > 0, "skip").otherwise(F.col("action")))


def checked_vectors(points: DataFrame, size: int) -> DataFrame:
    """`points` (vector), failing at the first vector of another size."""
    right = F.assert_true(F.size("vector") == size, F.concat(F.lit(f"a vector of {size} numbers was expected, not of "), F.size("vector").cast("string")))
    return points.withColumn("vector", F.when(right.isNull(), F.col("vector")))


def record_points(entities: DataFrame, split: bool) -> DataFrame:
    """(source_id, chapter_index, record, embedding_text) of entities (source_id, name_text, records: array<struct<chapter, text>>): a point for each record that says something, or one for all with the first's chapter."""
    good = F.filter("records", lambda r: r["chapter"].isNotNull() & (F.trim(F.coalesce(r["text"], F.lit(""))) != ""))
    rows = entities.select("source_id", "name_text", F.transform(good, lambda r: F.struct(r["chapter"].alias("chapter"), F.trim(r["text"]).alias("text"))).alias("r")).where(F.size("r") > 0)
    if split:
        rows = rows.select("source_id", "name_text", F.explode("r").alias("r")).select("source_id", "name_text", F.col("r.chapter").alias("chapter_index"), F.col("r.text").alias("record"))
    else:
        rows = rows.select("source_id", "name_text", F.col("r")[0]["chapter"].alias("chapter_index"), F.array_join(F.transform("r", lambda x: x["text"]), "\n").alias("record"))
    text = F.when(F.coalesce("name_text", F.lit("")) != "", F.concat("name_text", F.lit("："), "record")).otherwise(F.col("record"))
    return rows.select("source_id", "chapter_index", "record", text.alias("embedding_text"))


def parsed_time(text: Column) -> Column:
    """A date and time without its zone: ISO forms, a blank or T between, Z or an offset after it; null for others. The clock's own reading counts, not the zone's shift."""
    clean = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?:Z|[+-]\d{2}:?\d{2})$", "")
    good = clean.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?)?$")
    return F.when(good, F.regexp_replace(clean, "T", " ").try_cast("timestamp_ntz"))


def without_sessions(sessions: DataFrame, ids: DataFrame | None = None, book_id: int | None = None) -> DataFrame:
    """The sessions (session_id, book_id) that stay after those of a list, or of a book, are deleted; blank ids and books delete none."""
    if ids is not None:
        gone = ids.select(F.trim(F.col("session_id").cast("string")).alias("_gone")).where("_gone <> ''")
        return sessions.join(gone, F.col("session_id").cast("string") == F.col("_gone"), "left_anti")
    return sessions.where(~F.coalesce(F.col("book_id") == book_id, F.lit(False))) if (book_id or 0) > 0 else sessions


def boundary_hash(start: Column, end: Column, next_start: Column, next_end: Column, tail: Column, head: Column) -> Column:
    """What tells a boundary between two ranges apart: their ends and the hashes of the summaries that meet there."""
    short = lambda c: F.substring(F.sha1(F.trim(F.coalesce(c, F.lit("")))), 1, 16)
    return F.concat_ws("|", *[c.cast("string") for c in (start, end, next_start, next_end)], short(tail), short(head))
