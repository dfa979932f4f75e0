"""A Merkle manifest of a dataset: a digest for every row, a tree over each group's rows, one root over the groups, and a proof for every row.

A group's leaves stand in the order of their ids. While a group has several nodes, every FANOUT neighbours are hashed into one (the last run may be shorter); the node that is left is the group's subroot.
The subroots, in the order of their groups, are hashed into the root in the same way.

Levels are built with lag and lead. A stretch is DEPTH levels over blocks of FANOUT^DEPTH neighbours: one shuffle and one sort, then, level by level, columns at fixed offsets before and after a row, masked by its slot
in its run and by the run's length, are its siblings, and the row of a run's first child hashes all into the parent, whose row it is from then on. Every row takes over its ancestors' siblings from the last
row of that level above it. The stretch above reads the blocks' first rows; its siblings come down by an equi-join on the block.

What bounds a task's memory: one text while its digest is made; then a block of FANOUT^DEPTH digests. A group is numbered over ranges of its ids, whose counts alone are added up; a group with most rows is spread over its blocks.
To the driver goes one number, the largest group's size.

Defined cases: null fields are `-`; a null group is a group of its own, the first; rows with a null id come first in their group, and rows of one id go by their digest, so equal rows are leaves of their own with the same result in either order;
very long texts are hashed whole; an empty table gives an empty manifest; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import written

FANOUT = 8
DEPTH = 3
SHIFT = 3 * DEPTH
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PATH = "array<struct<left:string,right:string>>"


def digest(*parts: Column) -> Column:
    """H: the hexadecimal SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that no two lists of fields read alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*[field(v) for v in values])


def fold(start: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings on its path."""
    return F.aggregate(path, start, lambda h, s: digest(s["left"], h, s["right"]))


def proof(path: Column) -> Column:
    """H of all siblings on the path."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Adds pos (from 0) and n, a row's place among its key's rows and their number. `rows` has a column key that is never null."""
    dealt = rows.repartitionByRange(F.col("key"), *order).sortWithinPartitions("key", *order)
    dealt = written(dealt.withColumn("at", F.monotonically_increasing_id()))  # the partition's number and, in the low 33 bits, the row's
    counts = dealt.groupBy(F.col("key").alias("_k"), F.shiftright("at", 33).alias("_p")).agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    key = Window.partitionBy("_k")
    before = F.coalesce(F.sum("_n").over(key.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = written(counts.select("_k", "_p", "_first", before.alias("_base"), F.sum("_n").over(key).alias("n")))
    out = dealt.join(counts, (F.col("key") == F.col("_k")) & (F.shiftright("at", 33) == F.col("_p")))
    return out.withColumn("pos", F.col("at") - F.col("_first") + F.col("_base")).drop("at", "_k", "_p", "_first", "_base")


def above(n: Column, level: int) -> Column:
    """How many nodes a group of n has `level` levels higher."""
    return F.floor((n + (FANOUT**level - 1)) / FANOUT**level).cast("bigint")


def stretch(nodes: DataFrame) -> DataFrame:
    """Adds block, top (in a block's first row: the node DEPTH levels higher, or the subroot) and own (the siblings of the row and of its ancestors in the block, upwards)."""
    block = nodes.withColumn("block", F.shiftright("pos", SHIFT))
    inside = Window.partitionBy("key", "block").orderBy("pos")
    so_far = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out, here = block.withColumn("h0", F.col("digest")), []
    for k in range(DEPTH):
        h, step = f"h{k}", FANOUT**k
        place, count = F.shiftright("pos", 3 * k), above(F.col("n"), k)
        slot = F.pmod(place, F.lit(FANOUT))
        run = F.least(F.lit(FANOUT), count - place + slot)
        node = (F.pmod("pos", F.lit(step)) == 0) & (count > 1)
        names = [f"before{j}" for j in range(1, FANOUT)], [f"after{j}" for j in range(1, FANOUT)]
        out = out.withColumns({f"before{j}": F.lag(h, j * step).over(inside) for j in range(1, FANOUT)} | {f"after{j}": F.lead(h, j * step).over(inside) for j in range(1, FANOUT)})
        left = F.concat(*[F.when(slot >= j, F.col(f"before{j}")).otherwise("") for j in range(FANOUT - 1, 0, -1)])
        right = F.concat(*[F.when(slot + j < run, F.col(f"after{j}")).otherwise("") for j in range(1, FANOUT)])
        out = out.withColumn(f"s{k}", F.when(node, F.struct(left.alias("left"), right.alias("right")))).drop(*names[0], *names[1])
        parent = F.when(node & (slot == 0), digest(F.col(h), F.col(f"s{k}.right"))).when((count == 1) & (F.col("pos") == 0), F.col(h))
        out = out.withColumns({f"h{k + 1}": parent, f"p{k}": F.last(f"s{k}", ignorenulls=True).over(so_far)})
        here.append(F.col(f"p{k}"))
    own = F.filter(F.array(*here), lambda s: s.isNotNull()).cast(PATH)
    return out.withColumn("top", F.col(f"h{DEPTH}")).withColumn("own", own).drop(*[f"{c}{k}" for c in "hsp" for k in range(DEPTH + 1)])


def higher(nodes: DataFrame) -> DataFrame:
    """The nodes DEPTH levels higher: (key, pos, n, digest)."""
    return stretch(nodes.select("key", "pos", "n", "digest")).where(F.pmod("pos", F.lit(1 << SHIFT)) == 0).select("key", F.col("block").alias("pos"), above(F.col("n"), DEPTH).alias("n"), F.col("top").alias("digest"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The given nodes and those of every DEPTH levels above, up to one for each key."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(written(higher(levels[-1])))
        most = -(-most // (1 << SHIFT))
    return levels


def descended(levels: list[DataFrame], tops: DataFrame, carry: list[str]) -> DataFrame:
    """levels[0] with path, the siblings up to the root. `tops` has for each key the path above its subroot, and what else `carry` names."""
    paths = levels[-1].join(tops, "key").select(*levels[-1].columns, "path", *carry)
    for nodes in reversed(levels[:-1]):
        up = paths.select("key", F.col("pos").alias("block"), F.col("path").alias("_up"), *carry)
        paths = stretch(nodes).join(up, ["key", "block"]).select(*nodes.columns, F.concat("own", "_up").alias("path"), *carry)
    return paths


def manifest(rows: DataFrame, group: Column, order: Column, digest_col: str, keep: list[str]) -> DataFrame:
    """(keep..., digest, pos, n, path, subroot, root): every row of `rows` as a leaf with its digest, its place and the siblings on its way to the root."""
    group = group.cast("string")
    key = F.when(group.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), group))  # never null, in the order of the groups, a null group first
    leaves = rows.select(key.alias("key"), order.alias("_order"), F.col(digest_col).alias("digest"), F.struct(*keep).alias("_kept"))
    leaves = written(numbered(leaves, [F.col("_order").asc_nulls_first(), F.col("digest")]).drop("_order"))
    levels = climbed(leaves)
    subroots = levels[-1].select(F.lit("").alias("key"), F.col("key").alias("_group"), "digest")
    subroots = written(numbered(subroots, [F.col("_group")]))
    over = climbed(subroots)
    roots = over[-1].select("key", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    tops = descended(over, roots, ["root"]).select(F.col("_group").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    return descended(levels, written(tops), ["subroot", "root"]).select("_kept.*", "digest", "pos", "n", "path", "subroot", "root")


def audited(found: DataFrame, leaf_now: Column) -> DataFrame:
    """Adds folded_root, from the row's leaf as it is now and its recorded siblings, and verified."""
    return found.withColumn("folded_root", fold(leaf_now, F.col("path"))).withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """The manifest of all documents by language, audited where one document in three may have its capitals lost."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 0
    changed = F.when(hit & F.col("text").rlike("[A-Z]"), leaf(*[F.col(c) for c in FIELDS[:-1]], F.translate("text", UPPER, LOWER)))
    rows = docs.select("doc_id", "lang", leaf(*[F.col(c) for c in FIELDS]).alias("leaf"), changed.alias("tampered"))
    found = audited(manifest(rows, F.col("lang"), F.col("doc_id"), "leaf", ["doc_id", "tampered"]), F.coalesce("tampered", "digest"))
    return found.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _levels_sql(nodes: str, name: str, levels: int) -> str:
    """CTEs of the levels above `nodes` (key, pos, n, h): each has for every node its run's siblings before and after it."""
    out = []
    for k in range(levels):
        source = nodes if k == 0 else f"{name}{k - 1}p"
        run = "PARTITION BY key, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"{name}{k} AS (SELECT *, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS l, CASE WHEN n > 1 THEN coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS r FROM {source})")
        out.append(f"{name}{k}p AS (SELECT key, pos // 8 AS pos, (max(n) + 7) // 8 AS n, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY {name}{k}.pos)) ELSE min(h) END AS h FROM {name}{k} GROUP BY key, {name}{k}.pos // 8)")
    return ",\n".join(out)


def _path_sql(name: str, levels: int, key: str, pos: str) -> tuple[str, list[str]]:
    return " ".join(f"JOIN {name}{k} ON {name}{k}.key = {key} AND {name}{k}.pos = {pos} // {8**k}" for k in range(levels)), [f"{name}{k}" for k in range(levels)]


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value} END"


def op13_sql(levels: int = 8) -> str:
    """The same in DuckDB, with the levels written out: enough for 8^8 rows of a language and 8^3 languages."""
    fields = " || ".join(_field_sql(c) for c in FIELDS)
    tampered = " || ".join(_field_sql(c if c != "text" else f"translate(text, '{UPPER}', '{LOWER}')") for c in FIELDS)
    joins, names = _path_sql("d", levels, "b.key", "b.pos")
    tops, above_names = _path_sql("g", 3, "t.key", "t.pos")
    siblings = " || ".join(f"coalesce({x}.l || {x}.r, '')" for x in [*names, *above_names])
    steps = [f"f{i + 1} AS (SELECT *, CASE WHEN l{i} IS NULL THEN f{i} ELSE sha256(l{i} || f{i} || r{i}) END AS f{i + 1} FROM f{i})" for i in range(levels + 3)]
    sides = ", ".join(f"{x}.l AS l{i}, {x}.r AS r{i}" for i, x in enumerate([*names, *above_names]))
    return f"""WITH bits AS (SELECT n::BIGINT AS n, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n::BIGINT) AS t FROM range(256) x(n)),
tab AS (SELECT list(t ORDER BY n) AS t FROM bits),
hits AS (SELECT doc_id, xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)]), 4294967295), 4294967295) % 3 = 0 AS hit FROM (SELECT DISTINCT doc_id FROM documents) JOIN tab ON true),
base AS (SELECT d.doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS key, sha256({fields.replace("doc_id", "d.doc_id")}) AS leaf, CASE WHEN hit THEN sha256({tampered.replace("doc_id", "d.doc_id")}) END AS tampered FROM documents d LEFT JOIN hits USING (doc_id)),
b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY key) AS n, leaf AS h FROM base),
{_levels_sql("(SELECT key, pos, n, h FROM b)", "d", levels)},
t AS (SELECT '' AS key, key AS lang_key, row_number() OVER (ORDER BY key) - 1 AS pos, count(*) OVER () AS n, h FROM d{levels - 1}p),
{_levels_sql("t", "g", 3)},
f0 AS (SELECT b.doc_id, b.leaf, t.h AS subroot, (SELECT h FROM g2p) AS root, sha256({siblings}) AS proof_sha256, coalesce(b.tampered, b.leaf) AS f0, {sides}
  FROM b {joins} JOIN t ON t.lang_key = b.key {tops}),
{", ".join(steps)}
SELECT doc_id, leaf, subroot, root, proof_sha256, f{levels + 3} AS folded_root, f{levels + 3} = root AS verified FROM f{levels + 3}"""
