"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every source's documents are shuffled (by a seeded hash), laid end to end and cut into blocks of `block` words. The mix is a row of
slots. Slot i has the point frac(i * golden ratio); the source whose stretch of the cumulative weights holds the point gets the slot. A
source's slots are ranked: its k-th slot takes its k-th block, beginning again after the last one. A source's last slot takes only the words
that its target leaves, and a source that the points left a few slots short gets them at the end of the schedule.

Targets: sources in code point order (null last) weigh 1, 2, 3, repeating, and share all words by weight; no target is above `most` times
its source's words, what it exceeds is shared by the others by weight. This is t = min(most * size, level * weight) with one level for all sources.

No source is gathered in one task: running sums and ranks go over hash buckets (of about 2,000 documents) and slot blocks whose sums are aggregated first. The list of
sources has one row for each source and is the only thing that is ordered as a whole.

What bounds a task's memory: one text, whose words are counted where it lies and cut only where a part of it is taken, and one bucket of numbers.

Defined cases: null texts and texts without words have size 0 and are never taken; very long texts are counted whole and may be taken in stretches; ties of the shuffle's hash are settled by id, size and the
text's hash, so reruns agree; rows equal in all of these are interchangeable; repeated rows are documents of their own; a
source without words has target 0; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import WORD, checkpointed, running_sum, words, written

BLOCK = 64
MOST = 3
SEED = 17
BUCKET_ROWS = 2000
SLOT_ROWS = 1 << 16
CELLS = 1024
#: frac(golden ratio), and frac(2^20 * golden ratio): the fraction of i * golden ratio stays exact to 1e-9 for 10^12 slots.
STEP, BIG_STEP = 0.6180339887498949, (0.6180339887498949 * (1 << 20)) % 1.0


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def targets(rows: DataFrame, most: int = MOST) -> DataFrame:
    """(source, n, size, target) of each source of `rows` (source, size)."""
    sizes = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sizes = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    cap = most * F.col("size")
    everywhere = Window.partitionBy(F.lit(0))
    by_cap = Window.partitionBy(F.lit(0)).orderBy(cap / F.col("weight"), F.col("source").asc_nulls_last())
    filled = F.coalesce(F.sum(cap).over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.sum("size").over(everywhere) - filled) / F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    # In order of cap / weight, the level of the first source that is below its cap is the level of all that follow.
    sizes = sizes.withColumn("level", level).withColumn("open", cap / F.col("weight") > F.col("level"))
    sizes = sizes.withColumn("level", F.min(F.when(F.col("open"), F.struct(cap / F.col("weight"), "level"))).over(everywhere)["level"])
    return sizes.select("source", "n", "size", F.coalesce(F.least(cap.cast("double"), F.col("weight") * F.col("level")), cap.cast("double")).alias("target"))


def _laid(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """`rows` (id, source, size, h) with their source's numbers and `start`, their first word on its line."""
    plan = sources.select(F.col("source").alias("_s"), "n", F.col("size").alias("source_size"), "target")
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The line's order is the hash's order: the buckets are equal stretches of the hash's range.
    buckets = F.ceil(F.col("n") / BUCKET_ROWS)
    rows = rows.withColumn("part", F.floor((F.col("h") / F.lit(2.0**64) + 0.5) * buckets).cast("bigint"))
    return running_sum(rows, "source", "part", [F.col("h"), F.col("id"), F.col("size"), F.col("tag")], F.col("size"), "start")


def schedule(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(slot, source, rank, block, epoch, words): which block of which source each slot takes, and how many of its words."""
    spark = sources.sparkSession
    sources = written(sources)
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    slots = int(total // block) + 1 if total else 0
    quota = F.floor("target").cast("bigint")
    plan = sources.where("size > 0").select("source", "size", "target", quota.alias("quota"))
    plan = plan.withColumn("blocks", F.ceil(F.col("size") / block)).withColumn("rest", F.col("quota") % F.col("size"))
    plan = plan.withColumn("need", F.floor(F.col("quota") / F.col("size")) * F.col("blocks") + F.ceil(F.col("rest") / block))
    line = Window.orderBy(F.col("source").asc_nulls_last())
    plan = plan.withColumn("high", F.sum("target").over(line.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total or 1.0))
    plan = plan.withColumn("low", F.coalesce(F.lag("high").over(line), F.lit(0.0)))
    # The last stretch ends above every point.
    plan = plan.withColumn("high", F.when(F.lead("high").over(line).isNull(), F.lit(2.0)).otherwise(F.col("high")))
    plan = written(plan.select("source", "blocks", "need", "rest", "size", "low", "high"))

    i = F.col("slot")
    point = F.pmod(F.shiftright(i, 20) * F.lit(BIG_STEP) + i.bitwiseAND(F.lit((1 << 20) - 1)) * F.lit(STEP), F.lit(1.0))
    points = spark.range(slots).withColumnRenamed("id", "slot").withColumn("point", point).withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    cells = plan.where("high > low").select("source", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("high") * CELLS).cast("int")))).alias("cell"))
    dealt = points.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "source")
    dealt = dealt.withColumn("part", F.floor(F.col("slot") / SLOT_ROWS))
    ranked = running_sum(dealt, "source", "part", [F.col("slot")], F.lit(1), "rank").select("slot", "source", "rank")

    given = dealt.groupBy("source").agg(F.count(F.lit(1)).alias("given")).withColumnRenamed("source", "_g")
    short = plan.join(given, F.col("source").eqNullSafe(F.col("_g")), "left").withColumn("given", F.coalesce("given", F.lit(0)))
    short = short.where("need > given").select("source", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank"))
    whole = ranked.unionByName(short.select(F.lit(slots).cast("bigint").alias("slot"), "source", "rank"))

    rule = plan.select(F.col("source").alias("_s"), "blocks", "need", "rest", "size")
    whole = whole.join(rule, F.col("source").eqNullSafe(F.col("_s"))).where("rank < need")
    nth, last = F.col("rank") % F.col("blocks"), F.col("rank") == F.col("need") - 1
    whole = whole.withColumn("block", nth).withColumn("epoch", F.floor(F.col("rank") / F.col("blocks")))
    left = F.when(last & (F.col("rest") > 0), F.col("rest") - F.col("block") * block)
    whole = whole.withColumn("words", F.coalesce(left, F.least(F.lit(block), F.col("size") - F.col("block") * block)))
    return whole.select("slot", "source", "rank", "block", "epoch", "words")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = BLOCK, most: int = MOST, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(rows, pieces): every row's numbers, and the stretches of words of each row that the mix takes.

    rows: id, tag (hash of the text), source, size, source_size, target, start. pieces: source, start, epoch, from_word, to_word, joined with `rows` on source and start.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), F.col(source_col).cast("string").alias("source"), n_words(text).alias("size"))
    rows = checkpointed(rows.withColumn("h", F.xxhash64("id", F.lit(seed))))
    sources = written(targets(rows, most))
    laid = checkpointed(_laid(rows, sources).select("id", "tag", "source", "size", "source_size", "target", "start"))
    # Slots of one block and epoch are one; what they take is aggregated before it meets the documents.
    taken = schedule(sources, block).groupBy("source", "block", "epoch").agg(F.sum("words").alias("words")).withColumnRenamed("source", "_s")
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = laid.where("size > 0").select("source", "start", "size", F.explode(F.sequence(first, last)).alias("at"))
    met = parts.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("at") == F.col("block")))
    low = F.greatest(F.col("at") * block, F.col("start")) - F.col("start")
    high = F.least(F.col("at") * block + F.col("words"), F.col("start") + F.col("size")) - F.col("start")
    pieces = met.select("source", "start", "epoch", low.alias("from_word"), high.alias("to_word")).where("to_word > from_word")
    return laid, pieces


def taken_words(laid: DataFrame, pieces: DataFrame) -> DataFrame:
    """`laid` with `taken`: the words that the mix takes of each row, repeats counted."""
    sums = pieces.groupBy("source", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken")).withColumnsRenamed({"source": "_s", "start": "_a"})
    met = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_a")) & (F.col("size") > 0)
    return laid.join(sums, met, "left").withColumn("taken", F.coalesce("taken", F.lit(0))).drop("_s", "_a")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how: int) -> DataFrame:
    """The mix as documents: all columns of `docs`, a row for each time that words of a document are taken.

    A row that is taken whole keeps its text; otherwise its text is the words that are taken, joined by one space.
    """
    laid, pieces = mix(docs, id_col, text_col, source_col, **how)
    # The words taken in one round through the source are one stretch: blocks are taken in order.
    spans = pieces.groupBy("source", "start", "epoch").agg(F.min("from_word").alias("a"), F.max("to_word").alias("b")).withColumnsRenamed({"source": "_s", "start": "_a"})
    met = F.col("source").eqNullSafe(F.col("_s")) & (F.col("start") == F.col("_a")) & (F.col("size") > 0)
    # Repeated rows (same id and text) have stretches of their own; each is paired with one row by its number.
    number = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.col("source").asc_nulls_last(), "start"))
    spans = laid.withColumn("_n", number).join(spans, met).select("id", "tag", "_n", F.col("size"), "a", "b")
    # The rows travel as one column, so their names can't clash with others.
    rows = docs.select(F.struct("*").alias("row"))
    of = lambda c: F.col("row")[c]
    rows = rows.withColumn("row_tag", F.xxhash64(F.coalesce(of(text_col).cast("string"), F.lit(""))))
    rows = rows.withColumn("row_n", F.row_number().over(Window.partitionBy(of(id_col), "row_tag").orderBy(of(source_col).asc_nulls_last())))
    rows = rows.join(spans, of(id_col).eqNullSafe(F.col("id")) & (F.col("row_tag") == F.col("tag")) & (F.col("row_n") == F.col("_n")))
    cut = F.array_join(F.slice(words(of(text_col)), (F.col("a") + 1).cast("int"), (F.col("b") - F.col("a")).cast("int")), " ")
    text = F.when((F.col("a") == 0) & (F.col("b") == F.col("size")), of(text_col)).otherwise(cut)
    return rows.select(*[(text if c == text_col else of(c)).alias(c) for c in docs.columns])


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    laid, pieces = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken_words(laid, pieces).select(F.col("id").alias("doc_id"), "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken"))
