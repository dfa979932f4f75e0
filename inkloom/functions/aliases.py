"""Alias texts as Column expressions: flattening of nested lists and brackets, display names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What parts aliases, what quotes them, and what is cut from their edges besides blanks.
SEPARATORS, QUOTES, EDGES = "、/／,，|｜;；", "\"'`“”‘’", "()（）[]【】<>《》"


def bare(text: Column, characters: str) -> Column:
    """A text without the given characters and blanks at its ends (blanks only if none are given)."""
    cut = rf"[\s{re.escape(characters)}]+"
    return F.regexp_replace(text, f"(?U)^{cut}|{cut}$", "")


def parted(text: Column) -> Column:
    """The parts between separators, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, f"[{SEPARATORS}]"), lambda x: bare(x, "")), lambda x: x != "")


def flattened(text: Column) -> Column:
    """The single aliases of a text, in order of depth.

    Each round opens every text that is still a list (its parts) or has a bracket (what is before it and the parts inside); the others are done, cut bare, and follow those of the rounds
    before. A text has at most as many rounds as opening brackets and one more for each.
    """
    opening = F.length(F.coalesce(text, F.lit(""))) - F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[（(]", ""))
    nothing = F.array().cast("array<string>")

    closed, any_ = "(?s)^(.*?)[（(]([^（）()]*)[）)]$", "(?s)^(.*?)[（(](.*)$"

    def opened(x: Column) -> Column:
        inside = lambda head, inner: F.filter(F.concat(F.array(bare(head, "")), parted(inner)), lambda y: y != "")
        last = inside(F.regexp_extract(x, closed, 1), F.regexp_extract(x, closed, 2))
        rest = inside(F.regexp_extract(x, any_, 1), F.regexp_replace(F.regexp_extract(x, any_, 2), "[）)]+$", ""))
        return F.when(F.size(parted(x)) > 1, parted(x)).when(x.rlike(closed), last).when(x.rlike("[（(]"), rest)

    def one_round(state: Column, _: Column) -> Column:
        bared = F.filter(F.transform(state["open"], lambda x: bare(x, QUOTES)), lambda x: x != "")
        return F.transform(F.array(F.transform(bared, lambda x: F.struct(x.alias("x"), opened(x).alias("more")))), lambda xs: F.struct(F.flatten(F.transform(F.filter(xs, lambda s: s["more"].isNotNull()), lambda s: s["more"])).alias("open"), F.concat(state["done"], F.transform(F.filter(xs, lambda s: s["more"].isNull()), lambda s: bare(bare(s["x"], EDGES), QUOTES + "）)"))).alias("done")))[0]

    start = F.struct(F.array(F.coalesce(text, F.lit(""))).alias("open"), nothing.alias("done"))
    return F.filter(F.aggregate(F.sequence(F.lit(0), 2 * opening + 1), start, one_round)["done"], lambda x: x != "")


def stored_aliases(name: Column, aliases: Column) -> Column:
    """A name's and its aliases' single aliases, distinct, in order."""
    every = F.concat(F.array(name), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(F.transform(every, flattened)))


def primary_and_aliases(raw: Column) -> Column:
    """struct(primary, aliases) of `name（alias/alias）`."""
    pattern = r"^(.*?)[（(]([^（）()]*)[）)]\s*$"
    once = lambda value, use: F.transform(F.array(value), use)[0]
    others = lambda block, primary: F.array_distinct(F.filter(F.transform(F.split(block, f"[{SEPARATORS}]+"), lambda x: F.trim(x)), lambda x: (x != "") & (x != primary)))
    named = lambda primary, block: F.struct(primary.alias("primary"), others(block, primary).alias("aliases"))
    parts = lambda t: F.struct(t.alias("text"), F.trim(F.regexp_extract(t, pattern, 1)).alias("head"), F.regexp_extract(t, pattern, 2).alias("block"))
    found = once(once(F.trim(F.coalesce(raw, F.lit(""))), parts), lambda p: F.struct(F.when(p["head"] == "", p["text"]).otherwise(p["head"]).alias("primary"), p["block"].alias("block")))
    return once(found, lambda n: named(n["primary"], n["block"]))


def display_name(primary: Column, aliases: Column) -> Column:
    others = F.filter(aliases, lambda a: a != primary)
    return F.when(F.size(others) > 0, F.concat(primary, F.lit("（"), F.array_join(others, "/"), F.lit("）"))).otherwise(primary)
