"""The relation graph: nodes, edges, history, node resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What in a status makes an edge hostile, friendly or neutral, in order of precedence, with the edge's colour; and the colours of nodes with and without a profile.
STATUS = (("hostile", ("敌", "冲突"), "rgba(248,113,113,0.72)"), ("friendly", ("盟", "信任", "合作"), "rgba(56,189,248,0.72)"), ("neutral", (), "rgba(148,163,184,0.5)"))
READY, STUB = "#38BDF8", "#94A3B8"


def category(status: Column) -> Column:
    out = F.lit(STATUS[-1][0])
    for name, words, _ in reversed(STATUS[:-1]):
        out = F.when(F.coalesce(status, F.lit("")).rlike("|".join(words)), name).otherwise(out)
    return out


def edge_color(status: Column) -> Column:
    kind = category(status)
    return F.coalesce(*[F.when(kind == name, color) for name, _, color in STATUS])


def node_color(profile_status: Column) -> Column:
    return F.when(F.coalesce(profile_status, F.lit("")) == "ready", READY).otherwise(STUB)


def highlights(edges: DataFrame, kind: str, key: str) -> DataFrame:
    """(edge_key, graph_key): what a chosen node or edge lights up: a node its edges, an edge itself and its two ends."""
    if kind == "node":
        return edges.where((F.col("source_key") == key) | (F.col("target_key") == key)).select("edge_key", F.lit(key).alias("graph_key"))
    return edges.where(F.col("edge_key") == key).select("edge_key", F.explode(F.array("source_key", "target_key")).alias("graph_key"))


def stub_upgrades(found: DataFrame) -> DataFrame:
    """Of resolved nodes (want_id, character_id, graph_key, how) those whose stub a character with an id takes over, with the key that it had."""
    return found.where(F.col("graph_key").startswith("stub:") & (F.col("how") == "stub") & (F.col("character_id") > 0)).select("want_id", "character_id", F.col("graph_key").alias("old_key"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`nodes` (node_id) with degree (a loop counts twice) and size. Edge ends are counted before they meet the nodes."""
    ends = edges.groupBy(F.col("source_id").alias("n")).agg(F.count(F.lit(1)).alias("d")).unionAll(edges.groupBy(F.col("target_id").alias("n")).agg(F.count(F.lit(1)).alias("d")))
    total = ends.groupBy("n").agg(F.sum("d").alias("_d"))
    return nodes.join(total, F.col("node_id") == F.col("n"), "left").withColumn("degree", F.coalesce("_d", F.lit(0))).withColumn("size", 18 + F.least(F.lit(20), 3 * F.col("degree"))).drop("n", "_d")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """`edges` with the names of both ends; edges with an unknown end are left out."""
    s = nodes.select(F.col("node_id").alias("_s"), F.col("name").alias("source_name"))
    t = nodes.select(F.col("node_id").alias("_t"), F.col("name").alias("target_name"))
    return edges.join(s, F.col("source_id") == F.col("_s")).join(t, F.col("target_id") == F.col("_t")).drop("_s", "_t")


def parallel(edges: DataFrame) -> DataFrame:
    """`edges` with pair_index and pair_count among the edges of the same two nodes, whatever their direction."""
    pair = [F.least("source_id", "target_id"), F.greatest("source_id", "target_id")]
    by = Window.partitionBy(*pair)
    return edges.withColumn("pair_index", F.row_number().over(by.orderBy("source_id", "target_id"))).withColumn("pair_count", F.count(F.lit(1)).over(by))


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of each key the row of the latest version (ties: the largest row)."""
    best = rows.groupBy(*keys).agg(F.max(F.struct(version, *[c for c in rows.columns if c not in (*keys, version)])).alias("_b"))
    return best.select(*keys, "_b.*")


def resolve_nodes(wanted: DataFrame, nodes: DataFrame, scope: str | None = None) -> DataFrame:
    """(want_id, graph_key, how): by character id; else the only stub that shares a name or alias; else a new key. With `scope` (a column of both, such as book_id) only nodes of one value of it are the same."""
    if scope:
        within = lambda c: F.concat_ws("\x1f", F.col(scope).cast("string"), c)
        names = lambda df: df.withColumns({"name": within(F.col("name")), "aliases": F.transform("aliases", within)})
        wanted, nodes = names(wanted), names(nodes)
        of = lambda df: F.when(F.coalesce("character_id", F.lit(0)) > 0, within(F.col("character_id").cast("string")))  # noqa: E731, ARG005
        ids = wanted.select("want_id", of(wanted).alias("_w")).join(nodes.select("graph_key", of(nodes).alias("_c")), F.col("_w") == F.col("_c")).groupBy("want_id").agg(F.min("graph_key").alias("_by_id"))
        rest = resolve_nodes(wanted.withColumn("character_id", F.lit(0)), nodes).withColumnsRenamed({"graph_key": "_other", "how": "_how"})
        rows = rest.join(ids, "want_id", "left")
        return rows.select("want_id", F.coalesce("_by_id", "_other").alias("graph_key"), F.when(F.col("_by_id").isNotNull(), "id").otherwise(F.col("_how")).alias("how"))
    named = nodes.select("graph_key", F.explode(F.array_append("aliases", F.col("name"))).alias("alias"), F.col("character_id").alias("_c"))
    by_id = wanted.where("character_id > 0").join(nodes.where("character_id > 0").select(F.col("character_id").alias("_c"), "graph_key"), F.col("character_id") == F.col("_c")).groupBy("want_id").agg(F.min("graph_key").alias("by_id"))
    asked = wanted.select("want_id", F.explode(F.array_append("aliases", F.col("name"))).alias("alias"))
    stubs = asked.join(named.where("coalesce(_c, 0) = 0"), "alias").groupBy("want_id").agg(F.min("graph_key").alias("stub"), F.countDistinct("graph_key").alias("n")).where("n = 1").drop("n")
    rows = wanted.join(by_id, "want_id", "left").join(stubs, "want_id", "left")
    how = F.when(F.col("by_id").isNotNull(), "id").when(F.col("stub").isNotNull(), "stub").otherwise("new")
    return rows.select("want_id", F.coalesce("by_id", "stub", F.concat(F.lit("new:"), F.col("want_id").cast("string"))).alias("graph_key"), how.alias("how"))


def history(islands: DataFrame) -> DataFrame:
    """(source_id, target_id, history): each edge's entries in order, as one text."""
    entry = F.concat_ws(" ", F.concat(F.col("chapter_start").cast("string"), F.lit("-"), F.col("chapter_end").cast("string")), "relation_type", "polarity", "strength")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("island", entry.alias("e")))), lambda x: x["e"])
    return islands.groupBy("source_id", "target_id").agg(F.array_join(rows, "; ").alias("history"))


def canvas(nodes: DataFrame, width: float = 1000.0) -> DataFrame:
    """`nodes` (x, y) scaled to 0..width by the extent of all, which is aggregated first and becomes a constant of the plan."""
    extent = nodes.agg(F.struct(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("low", F.min), ("high", F.max))]).alias("e")).scalar()
    scaled = lambda c: (F.col(c) - extent[f"low_{c}"]) / F.nullif(extent[f"high_{c}"] - extent[f"low_{c}"], F.lit(0.0)) * width
    return nodes.withColumn("cx", F.coalesce(scaled("x"), F.lit(width / 2))).withColumn("cy", F.coalesce(scaled("y"), F.lit(width / 2)))
