"""Exact dense search over cells: points lie in cells around centroids, and only cells that can hold a better point are read.

For unit vectors the distance d and the cosine are tied: cosine = 1 - d^2 / 2. A point of a cell is at least as far from a question as the centroid less the cell's radius, so its cosine is at most 1 - max(0, d(question, centroid) -
radius)^2 / 2. A search goes in two passes over equi-joins: the nearest cells that hold `most` points of the question's book give the score of the last place so far, and then all cells are read whose bound is not below it. Centroids
are fitted on SAMPLE points; every point is in a cell, and a zero or null vector is in none, as it has no cosine.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.components import written

SAMPLE = 10_000
MOST_CELLS = 1024
#: How many points and questions a task holds at most, about, and how many questions it goes through at a time.
BLOCK, PART, ROWS = 4096, 8192, 512
#: Bounds are made of rounded numbers; they are raised by this much.
SLACK = 1e-6


class Cells(NamedTuple):
    """points: (id, book_id, vector, cell); counts: (book_id, cell, n); cells: (cell, centroid, radius), MOST_CELLS at most."""

    points: DataFrame
    counts: DataFrame
    cells: DataFrame


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fitted(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centroids of unit vectors by k-means, from evenly spaced distinct ones."""
    distinct = np.unique(x, axis=0)
    found = distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)]
    for _ in range(rounds):
        at = (x @ found.T - 0.5 * (found**2).sum(1)).argmax(1)
        sums, sizes = np.zeros_like(found), np.bincount(at, minlength=len(found))
        np.add.at(sums, at, x)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def index(points: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> Cells:
    """The cells of points (id, book_id, vector), written; vectors are of one length."""
    spark = points.sparkSession
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = written(points.where(F.col("vector").isNotNull() & (square > 0)).select("id", F.col("book_id").cast("bigint").alias("book_id"), F.col("vector").cast("array<double>").alias("vector")))
    n = rows.count()
    cells = cells or min(MOST_CELLS, max(1, round(math.sqrt(n) / 2)))
    share = round(min(1.0, sample / max(n, 1)) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < share).limit(2 * sample).select("vector").toArrow().column(0).to_pylist()
    centroids = fitted(_unit(np.array(chosen)), cells) if chosen else np.zeros((0, 1))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(np.array(batch.column("vector").to_pylist(), dtype=float).reshape(batch.num_rows, -1)) if batch.num_rows else np.zeros((0, centroids.shape[1]))
            at = (x @ centroids.T - 0.5 * (centroids**2).sum(1)).argmax(1) if len(centroids) else np.zeros(len(x), int)
            far = np.linalg.norm(x - centroids[at], axis=1) if len(centroids) else np.full(len(x), 2.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "far"])

    placed = written(rows.mapInArrow(assign, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields) + ", cell int, far double"))
    counts = written(placed.groupBy("book_id", "cell").agg(F.count(F.lit(1)).alias("n")))
    radii = {r[0]: r[1] for r in placed.groupBy("cell").agg(F.max("far")).collect()}
    table = [(k, c.tolist(), float(radii[k])) for k, c in enumerate(centroids) if k in radii]
    return Cells(placed.drop("far"), counts, spark.createDataFrame(table, "cell int, centroid array<double>, radius double"))


def bounds(queries: DataFrame, cells: Cells) -> DataFrame:
    """(query_id, _book, _q, cell, n, bound): for every question the cells that hold points of its book, and how good a point there can be at best. The table of cells is small and goes to every task."""
    q = queries.select("query_id", F.col("book_id").cast("bigint").alias("_book"), F.col("vector").cast("array<double>").alias("_q"))
    mine = q.join(cells.counts, F.col("_book") == F.col("book_id")).drop("book_id").join(F.broadcast(cells.cells), "cell")
    size = F.sqrt(F.aggregate("_q", F.lit(0.0), lambda a, x: a + x * x))
    away = F.sqrt(F.aggregate(F.zip_with("_q", "centroid", lambda a, b: a / size - b), F.lit(0.0), lambda a, x: a + x * x))
    near = F.greatest(F.lit(0.0), away - F.col("radius") - SLACK)
    return mine.where(size > 0).select("query_id", "_book", "_q", "cell", "n", (1 - near * near / 2 + SLACK).alias("bound"))


def scored(visits: DataFrame, cells: Cells, most: int) -> DataFrame:
    """(query_id, id, score, rank) of the points in the visited cells, the best `most`.

    A cell's points of a book, in blocks of about BLOCK, meet the questions that visit it, in parts of about PART, as matrices. A block sends on what can be a question's `most` best of it, with scores by `cosine`'s own order of sums.
    """
    many = visits.groupBy(F.col("_book").alias("_b"), F.col("cell").alias("_c")).agg(F.ceil(F.count(F.lit(1)) / PART).alias("_parts"))
    sizes = cells.counts.join(many, (F.col("book_id") == F.col("_b")) & (F.col("cell") == F.col("_c"))).select("_b", "_c", F.ceil(F.col("n") / BLOCK).alias("_blocks"), "_parts")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1))
    points = cells.points.join(sizes, (F.col("book_id") == F.col("_b")) & (F.col("cell") == F.col("_c")))
    points = points.select(F.col("_b").alias("_pb"), F.col("_c").alias("_pc"), dealt("id", F.col("_blocks")).alias("_pblock"), every(F.col("_parts")).alias("_ppart"), "id", "vector")
    asked = visits.select("query_id", "_book", "cell", "_q").join(sizes, (F.col("_book") == F.col("_b")) & (F.col("cell") == F.col("_c")))
    asked = asked.select(F.col("_b").alias("_qb"), F.col("_c").alias("_qc"), every(F.col("_blocks")).alias("_qblock"), dealt("query_id", F.col("_parts")).alias("_qpart"), "query_id", "_q")

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(left) and len(right):
            x, q = _matrix(left["vector"]), _matrix(right["_q"])
            unit, sizes, lengths = _unit(x), _norms(x), _norms(q)
            for start in range(0, len(q), ROWS):
                some = _unit(q[start : start + ROWS]) @ unit.T
                least = np.partition(some, -most, axis=1)[:, -most, None] - SLACK if most < len(x) else np.full((len(some), 1), -np.inf)
                row, at = np.nonzero(~(some < least))
                for low in range(0, len(row), BLOCK):
                    r, c = row[low : low + BLOCK] + start, at[low : low + BLOCK]
                    out.append((r, c, np.add.accumulate(x[c] * q[r], axis=1)[:, -1] / (sizes[c] * lengths[r])))
        r, c, score = (np.concatenate(o) for o in zip(*out))
        return pa.Table.from_arrays([right["query_id"].take(pa.array(r)), left["id"].take(pa.array(c)), pa.array(score)], ["query_id", "id", "score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    found = points.groupBy("_pb", "_pc", "_pblock", "_ppart").cogroup(asked.groupBy("_qb", "_qc", "_qblock", "_qpart")).applyInArrow(near, f"query_id {kind(asked, 'query_id')}, id {kind(points, 'id')}, score double")
    return ranked(found, most)


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([v.flatten().to_numpy(zero_copy_only=False) for v in vectors.chunks]).reshape(len(vectors), -1)


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.add.accumulate(x * x, axis=1)[:, -1])


def ranked(found: DataFrame, most: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


def visits(queries: DataFrame, cells: Cells, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(found, first, second): what the first pass finds, and the cells of both passes (query_id, _book, _q, cell, n)."""
    order: Column = Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell")
    # Only numbers are written for every question and cell; the cells that are visited get the question's vector again.
    reach = written(bounds(queries, cells).drop("_q").withColumn("_before", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    vectors = queries.select(F.col("query_id").alias("_id"), F.col("vector").cast("array<double>").alias("_q"))
    asking = lambda rows: rows.join(vectors, F.col("query_id") == F.col("_id")).drop("_id")
    first = asking(reach.where(F.col("_before") < most))
    found = written(scored(first, cells, most))
    last = found.where(F.col("rank") == most).select(F.col("query_id").alias("_full"), F.col("score").alias("_least"))
    rest = reach.where(F.col("_before") >= most).join(last, F.col("query_id") == F.col("_full"))
    return found, first, asking(rest.where(F.col("bound") >= F.col("_least")).drop("_full", "_least"))



def dense(queries: DataFrame, cells: Cells, most: int) -> DataFrame:
    """(query_id, id, score, rank): for each question (query_id, book_id, vector) its book's points of the largest cosine, ties by id: the same as a search of all points."""
    found, _, second = visits(queries, cells, most)
    return ranked(found.drop("rank").unionByName(scored(second, cells, most).drop("rank")), most)
