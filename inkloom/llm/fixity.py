"""WARC records and a Merkle fixity audit of replicas.

Records are laid out in files by number; a record's digest is that of its whole bytes. A file's tree has the records as leaves, in order; a node covers FANOUT
neighbours, with the stretch of offsets and the total length of what it covers, and its digest is that of its children's digests and its length.
Trees are built level by level with aggregations over at most FANOUT rows. Two replicas are compared by their roots; only below
roots that differ the next level is looked at, and so on down to the records, where the two sides are matched by record id.

A record's place in the tree is its number in its file, which stays when a neighbour is lost; so a lost record spoils its own branch only.

What bounds a task's memory: one record while its digest is made; then a file's `file_rows` numbers, of which no task gathers more than FANOUT at a time into a node.

Defined cases: null payloads and URLs are empty; rows without a number are dealt over SPARE files of negative numbers by what they hold; very long payloads are hashed whole; rows of one number are ordered by their digest, and the second and
later ones are further records of the leaf, audited by their order (rows of one number lie in one file's window: numbers are meant to tell records apart); a record that only the other replica has is `extra`; repeated rows are records of
their own; empty tables give empty trees; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.llm.common import checkpointed

FANOUT = 16
FILE_ROWS = 1000
END = "\r\n\r\n"
SPARE = 1 << 16
#: When the records were made, for tables that don't say.
DATE = "2000-01-01T00:00:00Z"


def record(number: Column, url: Column, payload: Column, date: str = DATE) -> Column:
    """A WARC resource record, without the empty lines that end it."""
    payload, clean = F.coalesce(payload, F.lit("")), lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "[\r\n]", " ")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:"), clean(number), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), clean(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(END))
    return F.concat(head, payload)


def layout(pages: DataFrame, number_col: str = "page_id", url_col: str = "url", payload_col: str = "html", file_rows: int = FILE_ROWS) -> DataFrame:
    """(number, file, slot, offset, length, digest, record): where each page's record lies in its file. A file holds `file_rows` numbers, so a window over it is bounded."""
    n = F.col(number_col).cast("bigint")
    rows = pages.select(n.alias("number"), F.coalesce(F.floor(n / file_rows), -1 - F.pmod(F.xxhash64(url_col, payload_col), F.lit(SPARE))).cast("bigint").alias("file"), F.coalesce(F.pmod(n, F.lit(file_rows)), F.lit(0)).cast("bigint").alias("slot"), record(n, F.col(url_col), F.col(payload_col)).alias("record"))
    rows = rows.withColumn("digest", F.sha2(F.concat("record", F.lit(END)), 256)).withColumn("length", (F.octet_length("record") + len(END)).cast("bigint"))
    in_file = Window.partitionBy("file").orderBy("slot", "digest")
    return rows.withColumn("offset", F.coalesce(F.sum("length").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _above(nodes: DataFrame) -> DataFrame:
    """The level above: (file, node, digest, offset, length)."""
    kids = F.sort_array(F.collect_list(F.struct("node", "offset", "digest")))
    up = nodes.groupBy("file", F.shiftright("node", 4).alias("up")).agg(kids.alias("kids"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    digest = F.sha2(F.concat(F.array_join(F.transform("kids", lambda k: k["digest"]), ""), F.col("length").cast("string")), 256)
    return up.select("file", F.col("up").alias("node"), digest.alias("digest"), "offset", "length")


def levels_for(file_rows: int) -> int:
    levels, n = 0, file_rows
    while n > 1:
        levels, n = levels + 1, -(-n // FANOUT)
    return levels


def tree(laid: DataFrame, file_rows: int = FILE_ROWS) -> list[DataFrame]:
    """The levels of the files' trees from the leaves (a leaf is a slot) to the roots."""
    leaf = F.sort_array(F.collect_list(F.struct("offset", "digest")))
    leaves = laid.groupBy("file", F.col("slot").alias("node")).agg(F.array_join(F.transform(leaf, lambda k: k["digest"]), "").alias("digest"), F.min("offset").alias("offset"), F.sum("length").alias("length"))
    levels = [leaves]
    for _ in range(levels_for(file_rows)):
        levels.append(checkpointed(_above(levels[-1])))
    return levels


def differing(left: list[DataFrame], right: list[DataFrame]) -> list[DataFrame]:
    """(file, node) of the differing nodes of each level, from the roots down; below, only children of differing nodes are compared."""
    out: list[DataFrame] = []
    for a, b in zip(reversed(left), reversed(right)):
        if out:
            parents = out[-1].select(F.col("file").alias("_f"), F.col("node").alias("_n"))
            inside = (F.col("file") == F.col("_f")) & (F.shiftright("node", 4) == F.col("_n"))
            a, b = a.join(parents, inside, "left_semi"), b.join(parents, inside, "left_semi")
        b = b.select("file", "node", F.col("digest").alias("other"))
        both = a.select("file", "node", "digest").join(b, ["file", "node"], "full")
        out.append(checkpointed(both.where(~F.col("digest").eqNullSafe(F.col("other"))).select("file", "node")))
    return out


def audit(laid: DataFrame, replica: DataFrame, file_rows: int = FILE_ROWS) -> DataFrame:
    """(number, file, slot, status, digest, found): every record of either side that is not intact: corrupt, missing or extra."""
    laid = laid.select("number", "file", "slot", "offset", "length", "digest")
    replica = replica.select("number", "file", "slot", "offset", "length", "digest")
    bad = differing(tree(laid, file_rows), tree(replica, file_rows))[-1].select(F.col("file").alias("_f"), F.col("node").alias("_n"))
    here = (F.col("file") == F.col("_f")) & (F.col("slot") == F.col("_n"))
    nth = F.row_number().over(Window.partitionBy("file", "slot").orderBy("offset"))
    left, right = (x.join(bad, here, "left_semi").withColumn("nth", nth) for x in (laid, replica))
    right = right.select("number", "file", "slot", "nth", F.col("digest").alias("found"))
    both = left.select("number", "file", "slot", "nth", "digest").join(right.withColumnRenamed("number", "_m"), ["file", "slot", "nth"], "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("digest").isNull(), "extra").when(F.col("found") != F.col("digest"), "corrupt")
    return both.select(F.coalesce("number", "_m").alias("number"), "file", "slot", "nth", status.alias("status"), "digest", "found").where("status IS NOT NULL")


def write_warc(laid: DataFrame, path: str) -> None:
    """One uncompressed WARC file for each `file` number, under path/file=N."""
    files = laid.select("file", "offset", "record").repartition("file").sortWithinPartitions("file", "offset")
    files.select("file", "record").write.partitionBy("file").option("lineSep", END).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, id, url, payload) of every record of the WARC files under a path; lengths are those that the records state."""
    from inkloom.llm.warcfile import records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = list(records(content.as_buffer()))
                offset, number, url, payload = zip(*rows) if rows else ((),) * 4
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(offset, pa.int64()), pa.array(number, pa.string()), pa.array(url, pa.string()), pa.array(payload, pa.binary())], ["path", "offset", "id", "url", "payload"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, offset bigint, id string, url string, payload binary")


def op8_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """All pages as WARC records, audited against a replica: in it, of the pages whose URL and number hash below 8 of 256 the payload has a changed beginning, and those that hash to 8 to 11 are lost."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    luck = F.conv(F.substring(F.md5(F.concat(F.coalesce("url", F.lit("")), F.lit("|"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 2), 16, 10).cast("int")
    damaged = F.when(luck < 8, F.concat(F.lit("?"), F.substring(F.coalesce("html", F.lit("")), 2, 1 << 30))).otherwise(F.col("html"))
    original = layout(pages)
    narrow = ["number", "file", "slot", "offset", "length", "digest"]
    original = checkpointed(original.select(*narrow))
    replica = checkpointed(layout(pages.where(~luck.between(8, 11)).withColumn("html", damaged)).select(*narrow))
    roots = tree(original)[-1].select(F.col("file").alias("_file"), F.col("digest").alias("file_root"))
    faults = audit(original, replica).where("status <> 'extra'").select(F.col("file").alias("_f"), F.col("slot").alias("_s"), F.col("nth").alias("_n"), "status")
    nth = F.row_number().over(Window.partitionBy("file", "slot").orderBy("offset"))
    rows = original.withColumn("nth", nth).join(faults, (F.col("file") == F.col("_f")) & (F.col("slot") == F.col("_s")) & (F.col("nth") == F.col("_n")), "left").join(roots, F.col("file") == F.col("_file"))
    return rows.select(F.col("number").alias("page_id"), "file", "slot", "offset", "length", "digest", F.coalesce("status", F.lit("intact")).alias("status"), "file_root")


OP8_SQL = """
WITH rec AS (
  SELECT page_id, page_id // 1000 AS file, page_id % 1000 AS slot,
    'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Date: 2000-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10)
      || html || chr(13) || chr(10) || chr(13) || chr(10) AS record,
    ('0x' || substr(md5(url || '|' || page_id), 1, 2))::INT AS luck
  FROM pages),
l0 AS (
  SELECT page_id, file, slot, luck, sha256(record) AS digest, strlen(record)::BIGINT AS length,
    coalesce(sum(strlen(record)) OVER (PARTITION BY file ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM rec),
l1 AS (SELECT file, slot >> 4 AS node, sha256(string_agg(digest, '' ORDER BY slot) || sum(length)::BIGINT) AS digest, sum(length)::BIGINT AS length FROM l0 GROUP BY ALL),
l2 AS (SELECT file, node >> 4 AS node, sha256(string_agg(digest, '' ORDER BY l1.node) || sum(length)::BIGINT) AS digest, sum(length)::BIGINT AS length FROM l1 GROUP BY file, l1.node >> 4),
l3 AS (SELECT file, sha256(string_agg(digest, '' ORDER BY l2.node) || sum(length)::BIGINT) AS file_root FROM l2 GROUP BY file)
SELECT page_id, file, slot, "offset", length, digest, CASE WHEN luck < 8 THEN 'corrupt' WHEN luck BETWEEN 8 AND 11 THEN 'missing' ELSE 'intact' END AS status, file_root
FROM l0 JOIN l3 USING (file)
"""
