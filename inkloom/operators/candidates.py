"""Candidates for one entity: items that share a title's root or that a record ties together, their groups, records and snippets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.names import BRIDGE_QUOTES, BRIDGES, HONORIFICS, TITLES, root, tight
from inkloom.operators.components import components
from inkloom.operators.evidence import GRAMS, beginning, begun, contained


def _names(items: DataFrame) -> DataFrame:
    """(item_id, name) of each item's name and aliases."""
    every = F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return items.select("item_id", F.explode(every).alias("name")).where(F.trim("name") != "")


def shared_roots(items: DataFrame, titles: tuple[str, ...] = HONORIFICS) -> DataFrame:
    """(root, item_id) of items (item_id, name, aliases): those one of whose names contains a root that some name has before a title; roots of two items and more."""
    names = _names(items).select("item_id", tight(F.col("name")).alias("name"))
    roots = names.select(root(F.col("name"), titles).alias("root")).where("root <> ''").distinct()
    held = contained(roots.select(F.col("root").alias("item_id"), F.col("root").alias("passage")), names.select("name").distinct().select(F.col("name").alias("doc_id"), F.col("name").alias("text")))
    met = held.select(F.col("item_id").alias("root"), F.col("doc_id").alias("name")).join(names, "name").select("root", "item_id").distinct()
    return met.join(met.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root"), "root")


def bridged(items: DataFrame) -> DataFrame:
    """(source_id, target_id): the item whose records (records: array<struct<chapter, text>>) name the other one after a bridge such as `called`, bare or quoted.

    What follows a bridge, or a bridge and an opening quote, meets the names by `begun`; after a quoted name its closing quote follows.
    """
    names = _names(items).select(F.col("item_id").alias("target_id"), F.trim("name").alias("passage"))
    records = items.select(F.col("item_id").alias("source_id"), F.explode("records").alias("r")).select("source_id", F.trim("r.text").alias("text")).where("text <> ''")
    texts = records.select(F.col("text").alias("doc_id"), "text").distinct()
    # Where a bridge ends, a piece does; the pieces' lengths give the places.
    pieces = F.split("text", "(?<=" + "|".join(BRIDGES) + ")")
    ends = F.aggregate(F.transform(pieces, F.length), F.array(F.lit(1)), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
    after = texts.select("doc_id", "text", F.explode(F.slice(ends, 2, F.size(ends) - 2)).alias("at"))
    one = F.col("text").substr(F.col("at"), F.lit(1))
    quoted = F.array(*[F.when(one == q if q else F.lit(True), F.struct((F.col("at") + len(q)).alias("at"), F.lit(BRIDGE_QUOTES[q]).alias("close"))) for q in BRIDGE_QUOTES])
    places = after.select("doc_id", "text", F.explode(F.array_compact(quoted)).alias("p")).select("doc_id", "text", "p.at", "p.close")
    whole = names.select(F.col("passage").alias("item_id"), "passage").distinct().withColumn("_k", beginning())
    met = None
    for k in GRAMS:
        starts = places.where(F.length("text") - F.col("at") + 1 >= k).select("doc_id", "at", F.col("text").substr(F.col("at"), F.lit(k)).alias("start")).distinct()
        found = begun(starts, whole.where(F.col("_k") == k), texts, k).select("doc_id", "at", "passage")
        met = found if met is None else met.unionByName(found)
    closed = met.join(places.select("doc_id", "at", "close"), ["doc_id", "at"]).where(F.col("doc_id").substr(F.col("at") + F.length("passage"), F.length("close")) == F.col("close"))
    held = closed.select(F.col("doc_id").alias("text"), "passage").distinct()
    return held.join(records, "text").join(names, "passage").where("source_id != target_id").select("source_id", "target_id").distinct()


def groups(items: DataFrame) -> DataFrame:
    """(group_id, item_id): items that share a title's root or are tied by a record, directly or over others; a group's id is its smallest item."""
    shared = shared_roots(items, TITLES)
    low = shared.groupBy("root").agg(F.min("item_id").alias("b"))
    edges = shared.join(low, "root").where("item_id != b").select(F.col("item_id").alias("a"), "b")
    edges = edges.unionByName(bridged(items).select(F.col("source_id").alias("a"), F.col("target_id").alias("b")))
    return components(edges).select(F.col("root").alias("group_id"), F.col("v").alias("item_id"))


def merged_records(records: DataFrame, key: str) -> DataFrame:
    """(key, nth, chapter, text) of rows (key, chapter: string, text): distinct ones, whole numbers first and by number, then others, then by text."""
    rows = records.select(key, F.trim("chapter").alias("chapter"), F.trim("text").alias("text")).distinct()
    number = F.col("chapter").try_cast("bigint")
    order = Window.partitionBy(key).orderBy(number.isNull(), number, F.when(number.isNull(), F.col("chapter")), "text")
    return rows.withColumn("nth", F.row_number().over(order).cast("bigint"))


def snippets(records: DataFrame, first: Column, most: int = 5) -> DataFrame:
    """Of each item's distinct records (item_id, place, chapter, text) those that `first` holds for, then the others, by place; the first five."""
    rows = records.withColumn("_first", F.coalesce(first, F.lit(False))).where(F.trim("text") != "")
    rows = rows.groupBy("item_id", "chapter", "text").agg(F.min("place").alias("place"), F.bool_or("_first").alias("prioritised"))
    order = Window.partitionBy("item_id").orderBy(F.desc("prioritised"), "place")
    return rows.withColumn("nth", F.row_number().over(order).cast("bigint")).where(F.col("nth") <= most)


def sampled_chapters(chapters: DataFrame, key: str, limit: int = 100, front: int = 20, back: int = 20) -> DataFrame:
    """(key, chapter_index): all of a key's distinct chapters if there are `limit` at most, else its first and last ones and of those between the ones with the smallest seeded hash."""
    rows = chapters.select(key, "chapter_index").where("chapter_index > 0").distinct()
    by = Window.partitionBy(key)
    rows = rows.withColumn("_all", F.count(F.lit(1)).over(by)).withColumn("_n", F.row_number().over(by.orderBy("chapter_index")))
    middle = (F.col("_all") > limit) & (F.col("_n") > front) & (F.col("_n") <= F.col("_all") - back)
    luck = F.row_number().over(Window.partitionBy(key, "_middle").orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("chapter_index").cast("string"))), "chapter_index"))
    return rows.withColumn("_middle", middle).withColumn("_luck", luck).where(~F.col("_middle") | (F.col("_luck") <= limit - front - back)).select(key, "chapter_index")


def chapter_descriptions(records: DataFrame) -> DataFrame:
    """(character_id, chapter_index, description) of rows (character_id, chapter_index, place, text): a chapter's distinct texts in order, joined."""
    firsts = records.groupBy("character_id", "chapter_index", "text").agg(F.min("place").alias("place"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    return firsts.groupBy("character_id", "chapter_index").agg(F.array_join(lines, "；").alias("description"))
