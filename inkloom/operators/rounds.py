"""Search in rounds: all parts of all questions act at once, each by its own state, until none has a need or a budget left.

Texts are read once: what a look at a chapter's summary or at its text would show a part is worked out for every chapter that its windows can reach (a found chapter and its neighbours), so the rounds themselves go over short rows.
A round takes every open part's best window of chapters that it hasn't done with, chooses an action (a check of summaries, or a reading of the text), grants actions within what is left of the question's budgets in order of
priority, and adds what they show to the evidence. State, evidence and chapters done with are written at the end of each round; a lost executor costs a round at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import coverage, query_terms
from inkloom.operators import answers, evidence
from inkloom.operators.components import written

#: How much of a part's terms a summary must have to be a hit, and a text to be evidence; how long a window is; after how many rounds without a new chapter a part gives up.
IN_SUMMARY, IN_TEXT, SPAN, STALE = 0.3, 0.8, 8, 2
CHECKED, READ = "chapter_summaries_verify", "chapters"


def looks(parts: DataFrame, hits: DataFrame, chapters: DataFrame, stopwords: list[str]) -> DataFrame:
    """(part_id, chapter_index, in_summary, in_text): which share of a part's terms the chapters in its reach have. chapters: (book_id, chapter_index, chapter_summary, content)."""
    near = F.explode(F.array(*[F.col("chapter_index") + d for d in (-1, 0, 1)])).alias("_c")
    reach = hits.select("part_id", near).where("_c > 0").distinct().join(parts.select("part_id", F.col("book_id").alias("_b"), query_terms(F.col("question"), stopwords).alias("_terms")), "part_id")
    met = chapters.join(reach, (F.col("book_id") == F.col("_b")) & (F.col("chapter_index") == F.col("_c")))
    share = lambda c: F.transform(F.array(F.lower(F.coalesce(F.col(c), F.lit("")))), lambda t: coverage(F.col("_terms"), t))[0]
    return met.select("part_id", F.col("chapter_index").cast("bigint"), share("chapter_summary").alias("in_summary"), share("content").alias("in_text"))


def chosen(state: DataFrame, found: DataFrame, done: DataFrame) -> DataFrame:
    """`state` with low, high (the window to act on), action (check, read or none) and why a part closes."""
    fresh = found.join(done, ["part_id", "chapter_index"], "left_anti")
    best = evidence.candidate_windows(evidence.clusters(fresh, keys=["part_id"]), SPAN, ["part_id"]).select(F.col("part_id").alias("_p"), F.col("start").alias("_low"), F.col("end").alias("_high"))
    sure = found.where(F.col("source") == READ).select(F.col("part_id").alias("_r"), F.lit(True).alias("_sure")).distinct()
    rows = state.join(best, F.col("part_id") == F.col("_p"), "left").join(sure, F.col("part_id") == F.col("_r"), "left")
    pending, opened = F.col("pending_low").isNotNull(), F.col("status").isNull()
    low, high = F.coalesce("pending_low", "_low"), F.coalesce("pending_high", "_high")
    why = F.when(F.coalesce("_sure", F.lit(False)), "resolved").when(F.col("stale") >= STALE, "no_new_coordinates").when(low.isNull(), "no_candidates")
    straight = answers.skips_summaries(F.col("intent"), low, high)
    return rows.withColumns({"low": low, "high": high, "why": F.when(opened, why), "action": F.when(opened & why.isNull(), F.when(pending | straight, "read").otherwise("check"))}).drop("_p", "_low", "_high", "_r", "_sure")


def granted(rows: DataFrame) -> DataFrame:
    """`rows` with the actions that the questions' budgets allow: in order (explicit parts first, then by priority) as many as calls are left, and as many readings as windows are left; others close."""
    question = Window.partitionBy("query_id")
    before = question.orderBy(F.desc("explicit"), "priority", "part_id")
    left = lambda budget, spent: F.col(budget) - F.sum(spent).over(question)
    wants, reads = F.col("action").isNotNull().cast("int"), (F.coalesce("action", F.lit("")) == "read").cast("int")
    rows = rows.withColumns({"_calls": left("tool_calls", "calls"), "_windows": left("fulltext_windows", "windows"), "_nth": F.sum(wants).over(before), "_read": F.sum(reads).over(before)})
    no = F.when(F.col("action").isNotNull(), F.when(F.col("_nth") > F.col("_calls"), "tool_budget").when((F.col("action") == "read") & (F.col("_read") > F.col("_windows")), "fulltext_budget"))
    return rows.withColumn("why", F.coalesce("why", no)).withColumn("action", F.when(no.isNull(), F.col("action"))).drop("_calls", "_windows", "_nth", "_read")


def research_rounds(parts: DataFrame, hits: DataFrame, chapters: DataFrame, stopwords: list[str], most_rounds: int = 20) -> DataFrame:
    """(query_id, part_id, status, reason, rounds, calls, windows, confidence, chapters, citations) of parts (query_id, part_id, priority, explicit, book_id, intent, question, tool_calls, fulltext_windows).

    hits: (part_id, source, chapter_index, score), what the first search found. A part is resolved when a text that it read has its terms; else its reason says why it ended.
    """
    spark = parts.sparkSession
    looked = written(looks(parts, hits, chapters, stopwords))
    nothing: Column = F.lit(None).cast("bigint")
    zero = F.lit(0).cast("bigint")
    state = written(parts.select("query_id", "part_id", "priority", "explicit", "intent", "tool_calls", "fulltext_windows", zero.alias("calls"), zero.alias("windows"), zero.alias("stale"), zero.alias("rounds"), nothing.alias("pending_low"), nothing.alias("pending_high"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("string").alias("reason")))
    found = written(hits.select("part_id", "source", F.col("chapter_index").cast("bigint"), "score"))
    done = spark.createDataFrame([], "part_id bigint, chapter_index bigint")
    for _ in range(most_rounds):
        acts = written(granted(chosen(state, found, done)))
        going = acts.where("action IS NOT NULL").select(F.col("part_id").alias("_p"), "action", F.col("low").alias("_low"), F.col("high").alias("_high"))
        seen = looked.join(going, (F.col("part_id") == F.col("_p")) & F.col("chapter_index").between(F.col("_low"), F.col("_high")))
        reading = F.col("action") == "read"
        seen = written(seen.select("part_id", "chapter_index", "action", F.when(reading, F.col("in_text") >= IN_TEXT).otherwise(F.col("in_summary") >= IN_SUMMARY).alias("hit")))
        new = seen.where("hit").select("part_id", F.when(reading, READ).otherwise(CHECKED).alias("source"), "chapter_index", F.when(reading, answers.STRUCTURED[READ]).otherwise(answers.STRUCTURED[CHECKED]).alias("score"))
        shown = seen.where("hit").groupBy("part_id").agg(F.min("chapter_index").alias("_first"), F.max("chapter_index").alias("_last"))
        unknown = new.join(found, ["part_id", "chapter_index"], "left_anti").select(F.col("part_id").alias("_n"), F.lit(True).alias("_new")).distinct()
        first, last = evidence.clipped(F.col("_first"), F.col("_last"), SPAN)
        rows = acts.join(shown.withColumnRenamed("part_id", "_s"), F.col("part_id") == F.col("_s"), "left").join(unknown, F.col("part_id") == F.col("_n"), "left")
        acted, hit = F.col("action").isNotNull(), (F.coalesce("action", F.lit("")) == "check") & F.col("_first").isNotNull()
        closed = F.when(F.col("why") == "resolved", "resolved").when(F.col("why").isNotNull(), "unresolved")
        after = {
            "calls": F.col("calls") + acted.cast("bigint"), "windows": F.col("windows") + (F.coalesce("action", F.lit("")) == "read").cast("bigint"), "rounds": F.col("rounds") + acted.cast("bigint"),
            "stale": F.when(acted, F.when(F.coalesce("_new", F.lit(False)), zero).otherwise(F.col("stale") + 1)).otherwise(F.col("stale")),
            "pending_low": F.when(hit, first), "pending_high": F.when(hit, last), "status": F.coalesce("status", closed), "reason": F.coalesce("reason", "why"),
        }
        next_state = written(rows.select(*[after.get(c, F.col(c)).alias(c) for c in state.columns]))
        # A reading settles its window; a check that shows nothing does too.
        empty = going.join(shown, F.col("_p") == F.col("part_id"), "left_anti").select(F.col("_p").alias("part_id"), "_low", "_high")
        read = going.where(reading).select(F.col("_p").alias("part_id"), "_low", "_high")
        settled = empty.unionByName(read).distinct().select("part_id", F.explode(F.sequence("_low", "_high")).alias("chapter_index"))
        done = written(done.unionByName(settled).distinct())
        windows = read.select(F.col("part_id").alias("subquery_id"), F.col("_low").alias("low"), F.col("_high").alias("high"))
        kept = evidence.without_summaries(found.withColumnRenamed("part_id", "subquery_id"), windows).withColumnRenamed("subquery_id", "part_id")
        found, state = written(kept.unionByName(new)), next_state
        if state.where("status IS NULL").isEmpty():
            break
    ranked = found.withColumns({"rank": F.row_number().over(Window.partitionBy("part_id").orderBy(F.desc("score"), "chapter_index", "source")), "plot_id": nothing, "volume_id": nothing}).join(state.select("part_id", "calls"), "part_id")
    sure = evidence.confidence(ranked, "part_id", "calls", state)
    read = found.where(F.col("source") == READ).groupBy("part_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("chapter_index")), lambda c: c.cast("string")), ",").alias("chapters"))
    out = state.join(sure, "part_id").join(read, "part_id", "left").join(evidence.citations(ranked, "part_id"), "part_id", "left")
    return out.select("query_id", "part_id", F.coalesce("status", F.lit("unresolved")).alias("status"), F.coalesce("reason", F.lit("most_rounds")).alias("reason"), "rounds", "calls", "windows", "confidence", F.coalesce("chapters", F.lit("")).alias("chapters"), F.coalesce("citations", F.lit("")).alias("citations"))
