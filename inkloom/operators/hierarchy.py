"""Chapters into plots and volumes: segmentation, grouping, ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import overlap_tokens
from inkloom.models import Summariser
from inkloom.operators.components import checkpointed


def plots_of(chapters: DataFrame) -> DataFrame:
    """(book_id, plot_id, start_chapter, end_chapter, chapter_count, chapter_data) of rows (book_id, plot_id, chapter_index, chapter_summary); plot 0 is none."""
    line = F.struct("chapter_index", F.concat(F.col("chapter_index").cast("string"), F.lit(": "), F.col("chapter_summary")).alias("line"))
    data = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")
    return chapters.where("plot_id > 0").groupBy("book_id", "plot_id").agg(F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter"), F.count(F.lit(1)).alias("chapter_count"), data.alias("chapter_data"))


def volumes_of(plots: DataFrame) -> DataFrame:
    """(book_id, volume_id, start_plot, end_plot, start_chapter, end_chapter, plot_count): the first plot's start and the last plot's end, by plot order."""
    return plots.groupBy("book_id", "volume_id").agg(
        F.min("plot_id").alias("start_plot"), F.max("plot_id").alias("end_plot"), F.min_by("start_chapter", "plot_id").alias("start_chapter"), F.max_by("end_chapter", "plot_id").alias("end_chapter"), F.count(F.lit(1)).alias("plot_count")
    )


def batch_number(row_number: Column, size: int) -> Column:
    return F.floor((row_number - 1) / size)


def segments(chapters: DataFrame, batch: int = 10) -> DataFrame:
    """(book_id, batch_no, start_chapter, end_chapter): ranges of neighbouring chapters inside batches; a new one begins where two neighbours with more than 3 tokens each share none."""
    rows = chapters.withColumn("tokens", overlap_tokens(F.col("chapter_summary"))).withColumn("batch_no", batch_number(F.col("chapter_index"), batch))
    order = Window.partitionBy("book_id", "batch_no").orderBy("chapter_index")
    rows = rows.withColumn("previous", F.lag("tokens").over(order))
    split = F.coalesce((F.size("tokens") > 3) & (F.size("previous") > 3) & ~F.arrays_overlap("tokens", "previous"), F.lit(False))
    rows = rows.withColumn("segment", F.sum(split.cast("int")).over(order))
    return rows.groupBy("book_id", "batch_no", "segment").agg(F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter")).drop("segment")


def stitched(ranges: DataFrame, key: str, order: str, joins: str) -> DataFrame:
    """One pass of pairwise stitching: of neighbouring ranges where `joins` (the boundary to the next one) holds, pairs are taken from left to right and a range is used once.

    In a run of boundaries that all hold, that takes the first, third, fifth and so on. Adds `group`, the number of the stitched range.
    """
    by = Window.partitionBy(key).orderBy(order)
    rows = ranges.withColumn("_joins", F.coalesce(F.col(joins), F.lit(False)))
    rows = rows.withColumn("_run", F.sum((~F.coalesce(F.lag("_joins").over(by), F.lit(False))).cast("int")).over(by))
    in_run = Window.partitionBy(key, "_run").orderBy(order)
    rows = rows.withColumn("_nth", F.row_number().over(in_run) - 1).withColumn("_first", (F.col("_nth") % 2) == 0)
    return rows.withColumn("group", F.sum(F.col("_first").cast("int")).over(by)).drop("_joins", "_run", "_nth", "_first")


def _round(ranges: DataFrame, disjoint: bool) -> DataFrame:
    """Ranges (book_id, start, end, head, tail: tokens of the first and last chapter) after one pass; with `disjoint` only the pairs (1, 2), (3, 4) and so on are looked at."""
    by = Window.partitionBy("book_id").orderBy("start")
    met = F.arrays_overlap("tail", F.lead("head").over(by))
    rows = ranges.withColumn("_met", F.coalesce(met, F.lit(False)))
    if disjoint:
        rows = rows.withColumn("_n", F.row_number().over(by) - 1)
        pair = F.floor(F.col("_n") / 2)
        joined = F.max(F.when(F.col("_n") % 2 == 0, F.col("_met")).otherwise(F.lit(False))).over(Window.partitionBy("book_id", pair))
        rows = rows.withColumn("group", F.when(joined, 2 * pair).otherwise(F.col("_n")))
    else:
        rows = stitched(rows, "book_id", "start", "_met")
    return rows.groupBy("book_id", "group").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("head", "start").alias("head"), F.max_by("tail", "start").alias("tail")).drop("group")


def stitched_rounds(ranges: DataFrame, most_rounds: int = 5, disjoint: bool = False) -> DataFrame:
    """(book_id, start, end): ranges stitched at boundaries whose chapters share a token, pass after pass until one changes nothing, `most_rounds` at most (plots take 5, volumes 8 of disjoint pairs)."""
    now = checkpointed(ranges.select("book_id", "start", "end", "head", "tail"))
    n = now.count()
    for _ in range(most_rounds):
        now = checkpointed(_round(now, disjoint))
        before, n = n, now.count()
        if n == before:
            break
    return now.select("book_id", "start", "end")


def clamped(ranges: DataFrame, batches: DataFrame) -> DataFrame:
    """(book_id, batch_no, start, end) of a model's ranges (book_id, batch_no, start, end) held within their batch (book_id, batch_no, low, high): missing ends are the batch's, inverted ranges are left out, a batch without any is one range."""
    b = batches.select(F.col("book_id").alias("_b"), F.col("batch_no").alias("_n"), "low", "high")
    rows = b.join(ranges, (F.col("book_id") == F.col("_b")) & (F.col("batch_no") == F.col("_n")), "left")
    start, end = F.greatest("low", F.coalesce(F.nullif("start", F.lit(0)), "low")), F.least("high", F.coalesce(F.nullif("end", F.lit(0)), "high"))
    rows = rows.select(F.col("_b").alias("book_id"), F.col("_n").alias("batch_no"), "low", "high", start.alias("start"), end.alias("end"), F.col("book_id").isNotNull().alias("given"))
    good = F.array_sort(F.collect_set(F.when(F.col("given") & (F.col("start") <= F.col("end")), F.struct("start", "end"))))
    per = rows.groupBy("book_id", "batch_no", "low", "high").agg(good.alias("good"))
    chosen = F.when(F.size("good") > 0, F.col("good")).otherwise(F.array(F.struct(F.col("low").alias("start"), F.col("high").alias("end"))))
    return per.select("book_id", "batch_no", F.explode(chosen).alias("r")).select("book_id", "batch_no", "r.*")


def halved(windows: DataFrame) -> DataFrame:
    """(key, half, chapters) of windows (key, chapters: array): both halves, the first one shorter if they differ; a window of one chapter stays away."""
    middle = F.greatest(F.lit(1), F.floor(F.size("chapters") / 2)).cast("int")
    halves = F.array(F.slice("chapters", F.lit(1), middle), F.slice("chapters", middle + 1, F.size("chapters")))
    return windows.where(F.size("chapters") > 1).select("key", F.posexplode(halves).alias("half", "chapters"))


def labelled_by_ranges(rows: DataFrame, ranges: DataFrame, coordinate: str = "chapter_index", start: str = "start_chapter", end: str = "end_chapter", label: str = "plot_id", width: int = 64) -> DataFrame:
    """`rows` with `label`: the number (by start, within the book) of the last range that holds the row's coordinate, 0 for none.

    Both sides meet on the book and a cell of `width` coordinates, so a book is no single key: ranges are put into each cell that they touch.
    """
    order = F.row_number().over(Window.partitionBy("book_id").orderBy(start, end))
    cells = ranges.select("book_id", order.alias("_label"), F.col(start).alias("_a"), F.col(end).alias("_z")).withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))))
    cells = cells.withColumnRenamed("book_id", "_book")
    met = (F.col("book_id") == F.col("_book")) & (F.floor(F.col(coordinate) / width) == F.col("_cell")) & F.col(coordinate).between(F.col("_a"), F.col("_z"))
    best = rows.select("book_id", coordinate).distinct().join(cells, met).groupBy("book_id", coordinate).agg(F.max("_label").alias("_best"))
    best = best.withColumnsRenamed({"book_id": "_b", coordinate: "_c"})
    return rows.join(best, (F.col("book_id") == F.col("_b")) & (F.col(coordinate) == F.col("_c")), "left").withColumn(label, F.coalesce("_best", F.lit(0))).drop("_b", "_c", "_best")


def containing_range(rows: DataFrame, ranges: DataFrame, coordinate: str = "chapter_index", number: str = "volume_id", start: str = "start_chapter", end: str = "end_chapter", width: int = 64) -> DataFrame:
    """`rows` with `number` of the first range (by number) of the same book that holds the coordinate, 0 for none.

    Both sides meet on the book and a cell of `width` coordinates, as in `labelled_by_ranges`: a book's rows don't meet all its ranges.
    """
    r = ranges.select(F.col("book_id").alias("_book"), F.col(number).alias("_n"), F.col(start).alias("_a"), F.col(end).alias("_z")).where("_a <= _z")
    r = r.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor(F.col("_z") / width))))
    met = (F.col("book_id") == F.col("_book")) & (F.floor(F.col(coordinate) / width) == F.col("_cell")) & F.col(coordinate).between(F.col("_a"), F.col("_z"))
    first = rows.select("book_id", coordinate).distinct().join(r, met).groupBy("book_id", coordinate).agg(F.min("_n").alias("_first"))
    first = first.withColumnsRenamed({"book_id": "_b", coordinate: "_c"})
    return rows.join(first, (F.col("book_id") == F.col("_b")) & (F.col(coordinate) == F.col("_c")), "left").withColumn(number, F.coalesce("_first", F.lit(0))).drop("_b", "_c", "_first")


def compressed(rows: DataFrame, size: int, summarise: Summariser) -> DataFrame:
    """(book_id, batch_no, first_chapter, last_chapter, packet): rows (book_id, chapter_index, text) in batches of `size` neighbours (volumes take 1, plots and chapters 5), each as one text, summarised."""
    line = F.struct("chapter_index", F.concat(F.col("chapter_index").cast("string"), F.lit(": "), F.coalesce("text", F.lit(""))).alias("line"))
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["line"]), "\n")
    found = rows.withColumn("batch_no", batch_number(F.col("chapter_index"), size)).groupBy("book_id", "batch_no").agg(F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), whole.alias("_whole"))
    return found.select("book_id", "batch_no", "first_chapter", "last_chapter", summarise(F.col("_whole")).alias("packet"))


def precheck(chapters: DataFrame, label: str = "plot_id") -> DataFrame:
    """(book_id, total, grouped, complete)."""
    found = chapters.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(label) > 0).alias("grouped"))
    return found.withColumn("complete", (F.col("total") > 0) & (F.col("total") == F.col("grouped")))


def neighbourhood(hits: DataFrame, available: DataFrame, around: int = 1) -> DataFrame:
    """(book_id, chapter_index): the hits with their neighbours, as far as there are such chapters."""
    near = hits.select("book_id", F.explode(F.sequence(F.col("chapter_index") - around, F.col("chapter_index") + around)).alias("chapter_index")).distinct()
    return near.join(available.select("book_id", "chapter_index"), ["book_id", "chapter_index"], "left_semi")
