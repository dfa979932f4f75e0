"""Entities: merging by alias, canonical names, resolution, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.components import components


def valid_characters(rows: DataFrame) -> DataFrame:
    """Characters (character_id, name, need_delete) that have an id and a name and aren't to be deleted."""
    return rows.where((F.coalesce(F.lower("need_delete"), F.lit("")) != "yes") & (F.col("character_id") > 0) & (F.trim(F.coalesce("name", F.lit(""))) != ""))


def with_single_record(rows: DataFrame, records: DataFrame) -> DataFrame:
    """The rows (character_id) that have exactly one of the records (character_id, record), equal ones counting once."""
    sole = records.distinct().groupBy(F.col("character_id").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n = 1")
    return rows.join(sole, F.col("character_id") == F.col("_c"), "left_semi")


def alias_components(items: DataFrame) -> DataFrame:
    """(item_id, component) of `items` (item_id, aliases): items that share an alias, directly or over others, are one; a component's id is its smallest item.

    Each alias ties its items to the smallest one, so edges grow with the aliases and not with pairs.
    """
    pairs = items.select("item_id", F.explode("aliases").alias("alias")).distinct()
    low = pairs.groupBy("alias").agg(F.min("item_id").alias("low")).withColumnRenamed("alias", "_alias")
    edges = pairs.join(low, F.col("alias") == F.col("_alias")).where("item_id <> low").select(F.col("item_id").alias("a"), F.col("low").alias("b")).distinct()
    found = components(edges).withColumnRenamed("root", "_root")
    return items.select("item_id").join(found, F.col("item_id") == F.col("v"), "left").select("item_id", F.coalesce("_root", "item_id").alias("component"))


def merged(items: DataFrame, member: DataFrame) -> DataFrame:
    """(component, name, aliases, n_items): the earliest item names its component; aliases in order of item and place."""
    rows = items.join(member, "item_id").select("component", "item_id", "name", F.posexplode("aliases").alias("pos", "alias"))
    firsts = rows.groupBy("component", "alias").agg(F.min(F.struct("item_id", "pos")).alias("at"))
    lists = firsts.groupBy("component").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "alias"))), lambda x: x["alias"]).alias("aliases"))
    names = items.join(member, "item_id").groupBy("component").agg(F.min_by("name", "item_id").alias("name"), F.count(F.lit(1)).alias("n_items"))
    return names.join(lists, "component", "left")


def folded_names(items: DataFrame) -> DataFrame:
    """Items of one name key (blanks and case aside) as one: the first name, the count of rows."""
    return items.withColumn("name_key", F.lower(F.regexp_replace("name", r"(?U)\s+", ""))).groupBy("name_key").agg(F.min_by("name", "item_id").alias("name"), F.count(F.lit(1)).alias("n_rows"), F.min("item_id").alias("first_id"))


def resolved(mentions: DataFrame, entities: DataFrame) -> DataFrame:
    """(mention_id, name): the one entity that claims a mention's key as its name or alias; null if none or several do."""
    claims = entities.select("name", F.explode(F.array_append("aliases", F.col("name"))).alias("alias")).select("name", F.lower(F.regexp_replace("alias", r"(?U)\s+", "")).alias("_key")).distinct()
    sole = claims.groupBy("_key").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    keyed = mentions.withColumn("_mention", F.lower(F.regexp_replace("mention", r"(?U)\s+", "")))
    return keyed.join(sole, F.col("_mention") == F.col("_key"), "left").select("mention_id", "name")


def canonical_names(candidates: DataFrame) -> DataFrame:
    """(group_id, name): of a group's candidates the most frequent, then the best ranked, the longest, the first by key."""
    counts = candidates.groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    best = Window.partitionBy("group_id").orderBy(F.desc("n"), "rank", F.desc(F.length("name")), "name")
    return counts.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("group_id", "name", "n")


def candidate_stats(candidates: DataFrame) -> DataFrame:
    """(group_id, name, occurrences, as_name, as_alias, items) of each candidate of a group."""
    return candidates.groupBy("group_id", "name").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if(F.col("role") == "name").alias("as_name"), F.count_if(F.col("role") == "alias").alias("as_alias"), F.countDistinct("item_id").alias("items"))


def cards(records: DataFrame, previews: int = 3) -> DataFrame:
    """(character_id, record_count, first_chapter, last_chapter, preview) of records (character_id, chapter_index, alias)."""
    alias = F.array_join(F.slice(F.array_sort(F.collect_set("alias")), 1, previews), "/")
    return records.groupBy("character_id").agg(F.count(F.lit(1)).alias("record_count"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), alias.alias("preview"))


def shared_root_groups(names: DataFrame, roots: list[str]) -> DataFrame:
    """(root, n): how many distinct names end in each of the given roots; groups of two and more. Names are matched by their last characters, an equality."""
    table = names.sparkSession.createDataFrame([(r, len(r)) for r in roots], "root string, k int")
    spans = names.select("name").distinct().withColumn("k", F.explode(F.array(*[F.lit(k) for k in sorted({len(r) for r in roots})])))
    ends = spans.withColumn("root", F.expr("right(name, k)"))
    return ends.join(F.broadcast(table), ["root", "k"]).groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")  # as many rows as given roots
