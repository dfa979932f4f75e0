"""SimHash near-duplicate detection with multi-index hashing.

A text's fingerprint has 64 bits. Two fingerprints that differ in at most 3 bits agree, up to one bit, in at least one of
their two 32-bit halves (if both halves differed in two bits or more, the whole would differ in four). So each half has a table of the
fingerprints by its value; a fingerprint looks up its half and the half's small Hamming ball, and the matches are verified
over all 64 bits. Of the two partners of a lookup at distance one, one has a 0 where the other has a 1: only flips of 0 to 1 are
looked up, which finds each pair once.

A half's value that many fingerprints share would make all their pairs. There the lookup goes on in the other half, by points instead
of pairs: fingerprints are within distance 3 exactly if the ball of radius 1 of one meets the ball of radius 2 of the other, and all that
lie within 1 of a point are linked with each other. So a point with at least one such fingerprint links all within 2 of it to that one, in
as many rows as it has members, and no link is lost.

Values next to a crowded one go by points too, or each fingerprint of the crowded value would meet all of theirs.

What bounds a task's memory: one text and its shingles' hashes, of which 65,536 at a time are counted; all else is rows of numbers that Spark sorts and spills.

Defined cases: null texts and texts without words have fingerprint 0 and link like any other; very long texts are read whole; a bit that exactly half the shingles have is 0; repeated rows each get their row;
null ids never become a component's id while the component has another; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import checkpointed
from inkloom.llm.components import components

SEED = 42


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint of one text: a bit is 1 if more than half the shingles' XXH64 have it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in parts:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - width])]
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :])], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65536):
        ones += np.unpackbits(h[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp): the 64-bit fingerprint of every row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.array([fingerprint_of(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seen, pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def near_links(points: DataFrame, most: int = 256) -> DataFrame:
    """(a, b): edges between rows of `points` (fp: distinct, node) that connect exactly what chains of links at 3 or fewer differing bits connect.

    `most` is where a half's value changes from pairs to points; it steers cost and not the result.
    """
    low = F.lit(0xFFFFFFFF)
    halves = points.select("fp", "node", F.explode(F.array(*(F.struct(F.lit(s).alias("half"), x.alias("v"), y.alias("other")) for s, x, y in ((0, F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", 32)), (1, F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(low)))))).alias("x")).select("fp", "node", "x.*")
    zero_bits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("getbit", F.col("v"), k) == 0)
    flips = halves.withColumn("k", F.explode(zero_bits)).select("fp", "node", "half", F.expr("v | shiftleft(1L, k)").alias("v"), "other")
    full = halves.groupBy("half", "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    hot_keys = checkpointed(full.select("half", "v"))
    # The values one bit above a crowded one, as far as there are any.
    beside = hot_keys.withColumn("k", F.explode(F.filter(F.sequence(F.lit(0), F.lit(31)), lambda k: F.call_function("getbit", F.col("v"), k) == 0))).select("half", F.expr("v | shiftleft(1L, k)").alias("v"))
    hot_keys = checkpointed(hot_keys.unionByName(halves.select("half", "v").join(beside, ["half", "v"], "left_semi")).distinct())

    table = halves.join(hot_keys, ["half", "v"], "left_anti")
    apart = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("t.fp")))
    same = table.alias("p").join(table.alias("t"), (F.col("p.half") == F.col("t.half")) & (F.col("p.v") == F.col("t.v")) & (F.col("p.fp") < F.col("t.fp")) & (apart <= 3))
    near = flips.alias("p").join(table.alias("t"), (F.col("p.half") == F.col("t.half")) & (F.col("p.v") == F.col("t.v")) & (apart <= 3))
    pairs = [x.select(F.col("p.node").alias("a"), F.col("t.node").alias("b")) for x in (same, near)]

    hot = halves.join(hot_keys, ["half", "v"], "left_semi").withColumn("role", F.lit(0))
    hot_flips = flips.join(hot_keys, ["half", "v"], "left_semi").withColumn("role", F.lit(1))
    bits = F.sequence(F.lit(0), F.lit(31))
    one = F.expr("array_append(transform(sequence(0, 31), i -> other ^ shiftleft(1L, i)), other)")
    two = F.flatten(F.transform(bits, lambda i: F.transform(F.filter(bits, lambda j: j < i), lambda j: F.col("other").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j)))))
    near_points = hot.unionByName(hot_flips).select("half", "v", "node", "role", F.explode(one).alias("point"))
    key = ["half", "v", "point"]
    # The smallest node whose half is v itself and whose other half is within 1 of the point is the point's centre.
    centres = near_points.where("role = 0").groupBy(*key).agg(F.min("node").alias("centre"), F.count(F.lit(1)).alias("held"))
    far_points = hot.select("half", "v", "node", F.lit(2).alias("role"), F.explode(two).alias("point"))
    stars = near_points.unionByName(far_points).join(centres, key).where(F.col("node") != F.col("centre")).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    return pairs[0].unionByName(pairs[1]).unionByName(stars).distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp, component_id) for every row: the smallest id that can be reached over links, the row's own included.

    Components are of fingerprints, so rows link through rows with null ids, and different fingerprints under one id stay apart.
    """
    rows = checkpointed(fingerprints(docs, id_col, text_col, width))
    points = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("least")))
    label = components(checkpointed(near_links(points.select("fp", F.col("fp").alias("node")))))
    rooted = checkpointed(points.join(label, points["fp"] == label["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select(F.col("fp").alias("_fp"), "root").join(least, "root").drop("root")
    return rows.join(known, F.col("fp") == F.col("_fp")).select("id", "fp", "component_id")


def op7_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component."""
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component_id"))


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: their id (null ids come last) and their text's hash."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("h"))


def first_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each row key in `keys` (key)."""
    chosen = keys.select(F.col("key").alias("_keep")).distinct()
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key")).join(chosen, F.col("key") == F.col("_keep"), "left_semi")
    nth = F.row_number().over(Window.partitionBy("key").orderBy(F.col("row")[text_col]))
    return rows.withColumn("nth", nth).where("nth = 1").select("row.*")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with one of each component: that with the smallest id (null only if there is no other), of equal ids the one with the smallest hash of its text."""
    found = simhash_components(docs.select(row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")), "key", "text")
    return first_rows(docs, found.select(F.col("component_id").alias("key")), id_col, text_col)
