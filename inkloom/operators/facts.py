"""Fact tables: entity and alias registries, mentions, unpivoted facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.payloads import let
from inkloom.operators.ranks import numbered_whole


def registry(mentions: DataFrame) -> DataFrame:
    """(entity_type, name_key, name, first_chapter, last_chapter, first_plot, last_plot, is_core) of mentions (entity_type, name, chapter_index, plot_id, is_core)."""
    key = F.lower(F.regexp_replace("name", r"(?U)\s+", ""))
    return mentions.withColumn("name_key", key).groupBy("entity_type", "name_key").agg(
        F.min("name").alias("name"), F.min("chapter_index").alias("first_chapter"), F.max("chapter_index").alias("last_chapter"), F.min("plot_id").alias("first_plot"), F.max("plot_id").alias("last_plot"), F.bool_or("is_core").alias("is_core")
    )


def with_ids(entities: DataFrame) -> DataFrame:
    """Registry rows numbered by type and key."""
    return numbered_whole(entities, [F.col("entity_type"), F.col("name_key")], "entity_id")


def mentions(flagged: DataFrame) -> DataFrame:
    """(chapter_index, name, flags...) of rows (chapter_index, name, flag): a column for each of the four lists that may name an entity."""
    has = lambda f: F.bool_or(F.col("flag") == f).alias(f"in_{f}")
    return flagged.groupBy("chapter_index", "name").agg(*map(has, ("core", "present", "mentioned", "hidden")))


def unpivoted(rows: DataFrame, key: str, lists: list[str]) -> DataFrame:
    """(key, kind, place, fact): the elements of several list columns, a row each."""
    kinds = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("facts")) for c in lists])
    flat = rows.select(key, F.explode(kinds).alias("k")).select(key, "k.kind", F.posexplode("k.facts").alias("place", "fact"))
    return flat.where("fact IS NOT NULL AND fact <> ''")


def unwrapped(name: Column) -> Column:
    """A trimmed name without the brackets around it."""
    bare = lambda mark, pattern: lambda t: F.when(t.startswith(mark) & t.rlike(pattern), F.trim(F.regexp_replace(t, pattern, "$1"))).otherwise(t)
    return let(let(F.trim(F.coalesce(name, F.lit(""))), bare("<", "(?s)^<(.+)>$")), bare("《", "(?s)^《(.+)》$"))


def canonical(name: Column) -> Column:
    """An entity's name without brackets and what follows a dash."""
    return let(unwrapped(name), lambda clean: let(F.trim(F.substring_index(clean, " - ", 1)), lambda head: F.when(head != "", head).otherwise(clean)))


def entity_key(name: Column) -> Column:
    """What tells entities of a type apart."""
    return F.lower(F.regexp_replace(canonical(name), r"(?U)\s+", ""))


def aliases_seen(mentions: DataFrame) -> DataFrame:
    """(entity_type, name_key, alias_key, alias_type, alias, first_seen, last_seen) of mentions (entity_type, name, alias, alias_type, chapter_index); chapters may be unknown."""
    rows = mentions.select("entity_type", entity_key(F.col("name")).alias("name_key"), entity_key(F.col("alias")).alias("alias_key"), "alias_type", canonical(F.col("alias")).alias("alias"), "chapter_index")
    return rows.where("alias_key <> ''").groupBy("entity_type", "name_key", "alias_key", "alias_type").agg(F.min("alias").alias("alias"), F.min("chapter_index").alias("first_seen"), F.max("chapter_index").alias("last_seen"))


def plot_entities(plots: DataFrame) -> DataFrame:
    """(entity_type, name_key, first_plot, last_plot, volume_id, is_core, importance) of plots (plot_id, volume_id, protagonists, important, organizations, people, factions): who appears, and
    whether the plot's key lists name it. Without a list of factions the organizations count."""
    factions = F.when(F.size("factions") > 0, F.col("factions")).otherwise(F.col("organizations"))
    listed = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("entity_type"), n.alias("name")))
    rows = plots.withColumn("e", F.explode(F.concat(listed("character", F.col("people")), listed("faction", factions)))).select("*", "e.*")
    name = canonical(F.col("name"))
    has = lambda c: F.array_contains(c, name)
    person = F.col("entity_type") == "character"
    importance = F.when(person & has("protagonists"), "protagonist").when(person & has("important") | ~person & has("organizations"), "important")
    rows = rows.withColumn("importance", importance).where(name != "")
    worth = F.when(F.col("importance") == "protagonist", 2).when(F.col("importance") == "important", 1).otherwise(0)
    return rows.groupBy("entity_type", entity_key(F.col("name")).alias("name_key")).agg(
        F.min("plot_id").alias("first_plot"), F.max("plot_id").alias("last_plot"), F.min_by("volume_id", F.when(F.col("volume_id").isNotNull(), F.col("plot_id"))).alias("volume_id"), F.bool_or(F.col("importance").isNotNull()).alias("is_core"), F.max_by("importance", worth).alias("importance")
    )


def with_entity_ids(facts: DataFrame, registry: DataFrame) -> DataFrame:
    """`facts` (name) with entity_id: the character's of that name, else the faction's."""
    of = lambda kind: registry.where(F.col("entity_type") == kind).select(F.col("name_key").alias(f"_{kind}"), F.col("entity_id").alias(f"_{kind}_id"))
    rows = facts.withColumn("_key", entity_key(F.col("name")))
    rows = rows.join(of("character"), F.col("_key") == F.col("_character"), "left").join(of("faction"), F.col("_key") == F.col("_faction"), "left")
    return rows.withColumn("entity_id", F.coalesce("_character_id", "_faction_id")).drop("_key", "_character", "_character_id", "_faction", "_faction_id")


def presence(entries: DataFrame, lists: list[str], scalars: list[str]) -> DataFrame:
    """One row for each name of entries (name, ord, lists, scalars): lists' distinct non-empty elements in order, scalars' last non-empty values."""
    rows = entries.withColumn("name", F.trim("name")).where("name <> ''")
    union = lambda c: F.array_distinct(F.filter(F.transform(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.coalesce(c, F.array().cast("array<string>")).alias("x")))), lambda s: s["x"])), lambda x: F.trim(x)), lambda x: x != "")).alias(c)
    last = lambda c: F.max_by(c, F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.col("ord"))).alias(c)
    return rows.groupBy("name").agg(F.min("ord").alias("ord"), *map(union, lists), *map(last, scalars))


def latest_asset(stored: DataFrame, new: DataFrame) -> DataFrame:
    """(book_id, asset_id, path): where a book's cover goes: the new path at its latest stored asset, or a new one (no id yet)."""
    held = stored.where("asset_type = 'cover'").groupBy("book_id").agg(F.max("asset_id").alias("asset_id")).withColumnRenamed("book_id", "_book")
    return new.join(held, F.col("book_id") == F.col("_book"), "left").select("book_id", "asset_id", "path")


#: The lists of a chapter's index and what each says of whom it names; the lists of other names, and the keys that an entry may have.
LISTS = (
    ("character", "character_index", "mentioned_characters", "is_mentioned"), ("character", "character_index", "active_characters", "is_active"), ("character", "character_index", "key_dialogue_speakers", "is_dialogue_speaker"),
    ("character", "character_index", "candidate_focus_characters", "is_focus_candidate"), ("faction", "faction_index", "mentioned_factions", "is_mentioned"), ("faction", "faction_index", "active_factions", "is_active"),
    ("faction", "faction_index", "candidate_focus_factions", "is_focus_candidate"),
)
OTHER_NAMES = (
    ("character", "character_index", "aliases_or_appellations", ("standard_name", "character_name", "name"), ("alias", "appellation", "title")),
    ("faction", "faction_index", "faction_aliases_or_titles", ("standard_name", "faction_name", "organization_name", "name"), ("alias", "title", "appellation", "organization_alias")),
)
FLAGS = ("is_mentioned", "is_active", "is_dialogue_speaker", "is_focus_candidate")


def named_in(payload: Column) -> Column:
    """array<struct<entity_type, flag, name, alias, alias_type>> of a chapter's index, a JSON text of any shape: who is in which list, and under which other names. The index may lie under entity_index; what isn't a list is none."""
    parsed = F.try_parse_json(payload)

    def index_of(v: Column, index: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"$.{index}", "variant"), F.try_variant_get(v, f"$.entity_index.{index}", "variant"))

    def listed(own: Column, name: str) -> Column:
        return F.coalesce(F.try_variant_get(own, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))

    text = lambda e, path="$": canonical(F.try_variant_get(e, path, "string"))
    none = F.lit(None).cast("string")

    def entry(kind: str, flag: Column, name: Column, alias: Column, alias_type: Column) -> Column:
        return F.struct(F.lit(kind).alias("entity_type"), flag.alias("flag"), name.alias("name"), alias.alias("alias"), alias_type.alias("alias_type"))

    def first(e: Column, keys: tuple[str, ...]) -> Column:
        return F.coalesce(*[let(text(e, f"$.{k}"), lambda t: F.when(t != "", t)) for k in keys], F.lit(""))

    def other(kind: str, names: tuple[str, ...], aliases: tuple[str, ...]):
        def of(e: Column) -> Column:
            found = F.when(F.schema_of_variant(e).startswith("OBJECT"), named(e)).otherwise(F.struct(text(e).alias("alias"), F.lit("").alias("name"), F.lit("").alias("kinds")))
            return let(found, lambda o: entry(kind, none, F.when(o["name"] != "", o["name"]).otherwise(o["alias"]), o["alias"], o["kinds"]))

        def named(e: Column) -> Column:
            kinds = F.coalesce(*[let(F.trim(F.try_variant_get(e, f"$.{k}", "string")), lambda t: F.when(t != "", t)) for k in ("type", "kind")], F.lit(""))
            return F.struct(first(e, aliases).alias("alias"), first(e, names).alias("name"), kinds.alias("kinds"))

        return of

    def flagged(items: Column, kind: str, flag: str) -> Column:
        return F.filter(F.transform(items, lambda e: entry(kind, F.lit(flag), text(e), none, none)), lambda s: s["name"] != "")

    def all_of(own: Column) -> Column:
        flags = [flagged(listed(own[index], name), kind, flag) for kind, index, name, flag in LISTS]
        others = [F.filter(F.transform(listed(own[index], name), other(kind, names, aliases)), lambda s: s["alias"] != "") for kind, index, name, names, aliases in OTHER_NAMES]
        return F.concat(*flags, *others)

    indexes = dict.fromkeys(index for _, index, _, _ in LISTS)
    return let(let(parsed, lambda v: F.struct(*[index_of(v, index).alias(index) for index in indexes])), all_of)


def index_mentions(chapters: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, entity_type, name_key, name, flags, source_aliases) of chapters' indexes: a row for each entity that a chapter names, as first spelled, with which lists have it and its other names in order."""
    rows = chapters.select(key, F.posexplode(named_in(F.col(payload))).alias("at", "n")).select(key, "at", "n.*").withColumn("name_key", entity_key(F.col("name")))
    keys = [key, "entity_type", "name_key"]
    # A key's other names are one chapter's, so they are put in order where they meet.
    aliases = F.sort_array(F.collect_list(F.when(F.col("alias") != "", F.struct("at", "alias"))))
    flags = [F.max((F.coalesce("flag", F.lit("")) == f).cast("int")).alias(f) for f in FLAGS]
    return rows.groupBy(*keys).agg(F.min_by("name", "at").alias("name"), *flags, F.array_distinct(F.transform(aliases, lambda x: x["alias"])).alias("source_aliases"))
