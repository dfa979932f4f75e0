"""The domain's tables, derived from the driver's: books of chapters, plots and volumes, messages, relation events."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions.text import word_count
from inkloom.models import edge_sentences
from inkloom.operators.components import written
from inkloom.operators.ranks import numbered


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return found.select(*columns) if columns else found


def spread(rows: DataFrame) -> DataFrame:
    """`rows` dealt over all cores: for short rows with much work each, whose file may be a single split."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def with_book(rows: DataFrame) -> DataFrame:
    """`rows` (source) with book_id: the source's number among the distinct ones by code point, null last. The list of sources has one row for each."""
    names = rows.select(F.col("source").alias("_source")).distinct().withColumn("book_id", F.row_number().over(Window.orderBy(F.col("_source").asc_nulls_last())).cast("bigint"))
    return rows.join(names, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


_scope: ContextVar[dict | None] = ContextVar("scope", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Inside it, what `once` makes is made once."""
    token = _scope.set({})
    try:
        yield
    finally:
        _scope.reset(token)


def once(name: str, sf_dir: str, make: Callable[[], DataFrame]) -> DataFrame:
    known = _scope.get()
    if known is None:
        return make()
    if (name, sf_dir) not in known:
        known[name, sf_dir] = make()
    return known[name, sf_dir]


def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id), written: a source is a book, its documents by id are its chapters. Only ids and sources are numbered; everything else finds its number by doc_id, which is the documents' key."""

    def make() -> DataFrame:
        rows = with_book(table(spark, sf_dir, "documents", "doc_id", "source"))
        return written(numbered(rows, "book_id", "doc_id", "chapter_index").select("book_id", "chapter_index", "doc_id"))

    return once("numbers", sf_dir, make)


def placed(rows: DataFrame, places: DataFrame) -> DataFrame:
    """`rows` (doc_id, ...) with the columns of `places` (doc_id, ...)."""
    places = places.withColumnRenamed("doc_id", "_doc")
    return rows.join(places, F.col("doc_id").eqNullSafe(F.col("_doc"))).drop("_doc")


def word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, word_count)."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", word_count(F.coalesce("text", F.lit(""))).cast("bigint").alias("word_count"))
    return placed(rows, numbers(spark, sf_dir)).select("book_id", "chapter_index", "doc_id", "word_count")


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, chapter_summary, word_count), written: what is made of a chapter's whole text, without it."""

    def make() -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", edge_sentences()(text).alias("chapter_summary"), word_count(text).cast("bigint").alias("word_count"))
        return written(placed(rows, numbers(spark, sf_dir)).select("book_id", "chapter_index", "doc_id", "chapter_summary", "word_count"))

    return once("cards", sf_dir, make)


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, content)."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return placed(rows, numbers(spark, sf_dir)).select("book_id", "chapter_index", "doc_id", "content")


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, doc_id, content, chapter_summary, word_count): the texts with their cards."""
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    return placed(rows, cards(spark, sf_dir)).select("book_id", "chapter_index", "doc_id", "content", "chapter_summary", "word_count")


def chapter_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book_id, chapter_index, plot_id, volume_id) without the texts: five chapters a plot, four plots a volume."""
    return with_hierarchy(numbers(spark, sf_dir))


def with_hierarchy(rows: DataFrame, plot_chapters: int = 5, volume_plots: int = 4) -> DataFrame:
    plot = F.floor((F.col("chapter_index") - 1) / plot_chapters) + 1
    return rows.withColumn("plot_id", plot).withColumn("volume_id", F.floor((F.col("plot_id") - 1) / volume_plots) + 1)


def statuses(polarity, strength):
    """What a relation stands at, by its polarity and strength."""
    high = strength == "high"
    return F.when(polarity == "negative", F.when(high, "公开冲突").otherwise("敌对")).when(polarity == "positive", F.when(high, "结盟").otherwise("合作信任")).otherwise("普通相识")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, message_id, role, content, token_count)."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return rows.select(F.col("conv_id").alias("session_id"), F.col("turn").alias("message_id"), "role", F.col("text").alias("content"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint").alias("token_count"))


def relation_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, target_id, chapter_start, chapter_end, relation_type, polarity, strength, summary): a supplier's nation with a customer's, chapters are months."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey")
    # Orders find their customers before the lines come in, which so are dealt by order only.
    owned = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    rows = items.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("bigint")
    return rows.select(
        F.col("s_nationkey").cast("bigint").alias("source_id"), F.col("c_nationkey").cast("bigint").alias("target_id"), month.alias("chapter_start"), (month + (F.col("l_linenumber") % 2)).cast("bigint").alias("chapter_end"),
        F.col("l_linestatus").alias("relation_type"), F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive").otherwise("neutral").alias("polarity"),
        F.when(F.col("l_quantity") > 33, "high").when(F.col("l_quantity") > 16, "medium").otherwise("low").alias("strength"), F.concat(F.lit("order "), F.col("l_orderkey").cast("string")).alias("summary"),
    )
