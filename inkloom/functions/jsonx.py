"""Tolerant JSON parsing as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def salvaged(raw: Column, opening: str = "{", closing: str = "}") -> Column:
    """The stretch from the first opening to the last closing bracket, without code fences around it."""
    text = F.coalesce(raw, F.lit(""))
    # A text in brackets is its own stretch.
    return F.when(text.startswith(opening) & text.endswith(closing), text).otherwise(F.regexp_extract(text, rf"(?s)(\{opening}.*\{closing})", 1))


def parsed(raw: Column, schema: str) -> Column:
    """The value of the given schema in the salvaged stretch (a whole JSON text is its own); null if there is none."""
    bracket = ("[", "]") if schema.lower().startswith("array") else ("{", "}")
    return F.from_json(F.nullif(salvaged(raw, *bracket), F.lit("")), schema)


def parsed_list(raw: Column, element: str = "string") -> Column:
    """A JSON list, empty for what isn't one."""
    return F.coalesce(parsed(raw, f"array<{element}>"), F.array().cast(f"array<{element}>"))


def records(raw: Column) -> Column:
    """[chapter, text] pairs of a list of mixed elements, those that are pairs with a whole chapter number: array<struct<chapter, text>>."""
    pairs = F.transform(parsed_list(raw), lambda x: F.from_json(x, "array<string>"))
    good = F.filter(pairs, lambda p: p.isNotNull() & (F.size(p) >= 2) & F.get(p, F.lit(0)).try_cast("bigint").isNotNull())
    return F.transform(good, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("bigint").alias("chapter"), F.trim(F.get(p, F.lit(1))).alias("text")))


def named_descriptions(raw: Column) -> Column:
    """array<struct<name, description>> of a list of objects whose name and description go by several keys; nameless ones are left out."""
    shape = "array<struct<name:string,title:string,character:string,description:string,desc:string,summary:string>>"
    first = lambda x, *ks: F.coalesce(*[F.nullif(F.trim(x[k]), F.lit("")) for k in ks], F.lit(""))
    items = F.transform(F.coalesce(parsed(raw, shape), F.array().cast(shape)), lambda x: F.struct(first(x, "name", "title", "character").alias("name"), first(x, "description", "desc", "summary").alias("description")))
    return F.filter(items, lambda x: x["name"] != "")


def positive_ints(items: Column) -> Column:
    """The distinct positive whole numbers of an array of strings, in order."""
    return F.array_distinct(F.filter(F.transform(items, lambda x: x.try_cast("bigint")), lambda x: x > 0))


def chapter_range(text: Column) -> Column:
    """struct(start, end) of `a-b`, `a~b`, `a—b` or `a`; null for others."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    of = lambda k: F.nullif(F.regexp_extract(clean, r"^(\d+)\s*(?:[-~—]\s*(\d+))?$", k), F.lit("")).cast("bigint")
    return F.when(of(1).isNotNull(), F.struct(of(1).alias("start"), F.coalesce(of(2), of(1)).alias("end")))
