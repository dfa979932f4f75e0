"""Hard negatives: for anchors and their nearest rows of the same label, the nearest rows of other labels inside a window of scores, exactly, by an inverted multi-index.

The index: vectors are cut into two halves, each with a codebook; a row's cell is its pair of codewords. Codebooks are fitted on about SAMPLE rows, twice as many at most (by a hash); every row is indexed. A cell's
rows are stored as blocks of BLOCK rows at most, so a cell with most rows is many blocks.
A search: for an anchor the inner product with any row of a cell is at most the sum of two half scores, each the codeword's inner product plus the half anchor's length times the codeword's radius. A multi-sequence heap over the two
sorted lists visits cells by falling sums. Two passes make a search exact: the first visits cells until they hold FIRST rows, which gives every window its last place's score so far; the second goes on in
the same order and ends where the next sum is below all of these scores (a window with places left ends at its own lower limit), so no cell that is left out can hold a better row. Visits meet blocks by an equi-join on the cell, and scores are
products of matrices of whole numbers.

What bounds a task's memory: a block and a pack of PACK anchors with their products; to the driver go the sample, and for each codeword its radius and for each cell its count (65,536 at most).

Defined cases: rows with a null label, a null vector, a null or non-finite component, a component of 2^26 or more after scaling (their products could leave a long), or another length than most vectors have, take no part; a null id ranks after all others in a
tie and is neither anchor nor positive of another null id; an anchor's repeated rows are one anchor, other repeated rows are candidates each; other rows are those of another id; ties go by the smaller id; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.llm.common import written

SAMPLE = 10_000
BLOCK = 1024
PACK = 256
FIRST = 4096
MOST_CODEWORDS = 256
LARGEST = 1 << 26
NO_ID = (1 << 63) - 1
LEAST = -(1 << 62)
#: Bounds are sums of rounded numbers and scores whole ones: a bound is raised by this share and by one.
SLACK = 1e-9


class Books(NamedTuple):
    """Codebooks and radii of both halves, and the cells' counts."""

    left: np.ndarray
    right: np.ndarray
    left_radius: np.ndarray
    right_radius: np.ndarray
    counts: np.ndarray


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of every component; null where a component is null, not finite or too large."""
    value = lambda x: F.lit(float(by)) * x.cast("double")
    good = F.forall(vector, lambda x: F.coalesce(F.abs(value(x)) < LARGEST, F.lit(False)))  # NaN is above all numbers
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(value(x)).cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def nearest(x: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every row's codeword and its distance."""
    at = ((codewords**2).sum(1) - 2 * x @ codewords.T).argmin(1)
    return at, np.sqrt(((x - codewords[at]) ** 2).sum(1))


def fitted(x: np.ndarray, codewords: int, rounds: int = 8) -> np.ndarray:
    """A codebook by k-means, from evenly spaced first codewords of the sample."""
    if not len(x):
        return np.zeros((1, x.shape[1]))
    distinct = np.unique(x, axis=0)
    found = distinct[np.linspace(0, len(distinct) - 1, min(codewords, len(distinct))).astype(int)]
    for _ in range(rounds):
        at, _ = nearest(x, found)
        sizes = np.bincount(at, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, at, x)
        found = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], found)
    return found


def heap_order(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) of all pairs by falling sums."""
    a, b = np.argsort(-left, kind="stable"), np.argsort(-right, kind="stable")
    u, v = left[a].tolist(), right[b].tolist()
    heap = [(-(u[0] + v[0]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        yield -total, int(a[i]), int(b[j])
        if j + 1 < len(v):
            heapq.heappush(heap, (-(u[i] + v[j + 1]), i, j + 1))
        if j == 0 and i + 1 < len(u):
            heapq.heappush(heap, (-(u[i + 1] + v[0]), i + 1, 0))


def visited(q: np.ndarray, books: Books, skip: int, least: float | None, first: int) -> list[int]:
    """The cells that an anchor visits: without `least` until they hold `first` rows, else all after the first `skip` ones whose bound is not below it. Empty cells are not counted."""
    half = books.left.shape[1]
    bounds = [(c @ p + np.sqrt(p @ p) * r) for p, c, r in ((q[:half], books.left, books.left_radius), (q[half:], books.right, books.right_radius))]
    out, rows, seen = [], 0, 0
    for total, i, j in heap_order(*bounds):
        if least is not None and total + abs(total) * SLACK + 1 < least:
            break
        cell = i * len(books.right) + j
        if not books.counts[cell]:
            continue
        seen += 1
        if seen > skip:
            out.append(cell)
        rows += books.counts[cell]
        if least is None and rows >= first:
            break
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best allowed scores of every row; of equal scores the first columns."""
    n = scores.shape[1]
    if int(np.abs(scores).max(initial=0)) >= (1 << 61) // n:
        at = np.argsort(np.where(allowed, -scores, -LEAST), axis=1, kind="stable")[:, :k]
        rows, cols = np.repeat(np.arange(len(scores)), at.shape[1]), at.ravel()
        return rows[allowed[rows, cols]], cols[allowed[rows, cols]]
    keys = np.where(allowed, scores * n + np.arange(n - 1, -1, -1), LEAST)  # no two alike
    if n > k:
        at = np.argpartition(-keys, k - 1, axis=1)[:, :k]
    else:
        at = np.broadcast_to(np.arange(n), scores.shape)
    rows, cols = np.repeat(np.arange(len(scores)), at.shape[1]), at.ravel()
    good = allowed[rows, cols]
    return rows[good], cols[good]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly."""
    largest = max(int(np.abs(a).max(initial=0)), 1) * max(int(np.abs(b).max(initial=0)), 1) * a.shape[1]
    if largest < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def mapped(df: DataFrame, run, schema: str) -> DataFrame:
    return df.mapInArrow(run, schema)


def indexed(rows: DataFrame, width: int, codewords: int | None, sample: int) -> tuple[DataFrame, Books]:
    """The blocks (cell, ids, labels, vectors) of all rows (id, label, vector), and the codebooks."""
    half, n = width // 2, rows.count()
    if codewords is None:
        codewords = min(MOST_CODEWORDS, max(4, 1 << round(math.log2(max(n, 1)) / 4)))
    share = round(min(1.0, sample / max(n, 1)) * (1 << 30))
    chosen = rows.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(1 << 30)) < share).limit(2 * sample).select("vector").toArrow().column(0).combine_chunks()
    points = matrix(chosen, width).astype(np.float64)
    left, right = fitted(points[:, :half], codewords), fitted(points[:, half:], codewords)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("vector"), width).astype(np.float64)
            (i, near), (j, far) = nearest(x[:, :half], left), nearest(x[:, half:], right)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((i * len(right) + j).astype(np.int32)), pa.array(near), pa.array(far)], [*batch.schema.names, "cell", "near", "far"])

    dealt = written(mapped(rows, assign, "id bigint, label int, vector array<int>, cell int, near double, far double"))
    counts, radii = np.zeros(len(left) * len(right), np.int64), [np.zeros(len(left)), np.zeros(len(right))]
    for cell, n, near, far in dealt.groupBy("cell").agg(F.count(F.lit(1)), F.max("near"), F.max("far")).collect():
        counts[cell] = n
        for side, at, r in ((0, cell // len(right), near), (1, cell % len(right), far)):
            radii[side][at] = max(radii[side][at], r)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("cell", "id", "label"))
            x = matrix(batch.column("vector"), width)
            edges = np.flatnonzero(np.diff(cells)) + 1
            cuts = [p for a, b in zip([0, *edges], [*edges, len(cells)]) for p in range(a, b, BLOCK)] + [len(cells)]
            out = []
            for a, b in zip(cuts, cuts[1:]):
                order = a + np.lexsort((labels[a:b], ids[a:b]))  # by id, for ties
                out.append((int(cells[a]), ids[order].tobytes(), labels[order].tobytes(), x[order].astype(np.int32).tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.binary()) for k in (1, 2, 3))], ["cell", "ids", "labels", "vectors"])

    spread = dealt.select("cell", "id", "label", "vector").repartitionByRange("cell", F.xxhash64("id", "vector")).sortWithinPartitions("cell")
    blocks = written(mapped(spread, packed, "cell int, ids binary, labels binary, vectors binary"))
    return blocks, Books(left, right, *radii, counts)


def searched(anchors: DataFrame, blocks: DataFrame, books: Books, width: int, windows: int, k: int, same: bool, first: int, again: bool) -> DataFrame:
    """(anchor, w, score, id): of the blocks that the anchors visit the k best rows of every block for every window, of the anchor's label or of other labels.

    `anchors` has anchor, id, label, vector, low and high (arrays of `windows` scores; a window whose low is above its high is none), and where this is the second pass (`again`) last, the windows' scores of their last place.
    """

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, PACK):
                part = batch.slice(start, PACK)
                q = matrix(part.column("vector"), width)
                low, high = (matrix(part.column(c), windows) for c in ("low", "high"))
                last = matrix(part.column("last"), windows) if again else None
                by_cell: dict[int, list[int]] = {}
                for n, x in enumerate(q.astype(np.float64)):
                    open_ = low[n] <= high[n]
                    if not open_.any():
                        continue
                    before = visited(x, books, 0, None, first)
                    cells = visited(x, books, len(before), float(last[n][open_].min()), first) if again else before
                    for cell in cells:
                        by_cell.setdefault(cell, []).append(n)
                if by_cell:
                    floor = last if again else low
                    names = [part.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "id", "label")]
                    rows = [(cell, *(c[at].tobytes() for c in names), q[at].astype(np.int32).tobytes(), np.maximum(low, floor)[at].tobytes(), high[at].tobytes()) for cell, at in by_cell.items()]
                    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[c] for r in rows], pa.binary()) for c in range(1, 7))], ["cell", "anchors", "q_ids", "q_labels", "q_vectors", "lows", "highs"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                at = lambda name, kind: np.frombuffer(batch.column(name)[n].as_buffer(), kind)  # noqa: E731, B023
                ids, labels, x = at("ids", np.int64), at("labels", np.int32), at("vectors", np.int32).reshape(-1, width)
                anchor, q_ids, q_labels = at("anchors", np.int64), at("q_ids", np.int64), at("q_labels", np.int32)
                lows, highs = (at(c, np.int64).reshape(-1, windows) for c in ("lows", "highs"))
                scores = products(at("q_vectors", np.int32).reshape(-1, width), x)
                fits = (q_labels[:, None] == labels) & (q_ids[:, None] != ids) if same else q_labels[:, None] != labels
                for w in range(windows):
                    r, c = best(scores, fits & (scores >= lows[:, w : w + 1]) & (scores <= highs[:, w : w + 1]), k)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(anchor[r]), pa.array(np.full(len(r), w, np.int32)), pa.array(scores[r, c]), pa.array(ids[c])], ["anchor", "w", "score", "id"])

    packs = mapped(anchors, visit, "cell int, anchors binary, q_ids binary, q_labels binary, q_vectors binary, lows binary, highs binary")
    # What visits send has no size that the planner could know, so it never goes to every task.
    return mapped(blocks.join(packs.hint("merge"), "cell"), score, "anchor bigint, w int, score bigint, id bigint")


def top(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of every window with their rank, by falling score and rising id."""
    rank = F.row_number().over(Window.partitionBy("anchor", "w").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def by_window(found: DataFrame, k: int, name: str) -> DataFrame:
    """(anchor, name): for every anchor a map from window to the score of its k-th place, where it has one."""
    full = found.where(F.col("rank") == k)
    return full.groupBy(F.col("anchor").alias("_a")).agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias(name))


def search(anchors: DataFrame, blocks: DataFrame, books: Books, width: int, windows: int, k: int, same: bool, first: int) -> DataFrame:
    """(anchor, w, score, id, rank): both passes; exact."""
    found = written(top(searched(anchors, blocks, books, width, windows, k, same, first, False), k))
    known = anchors.join(by_window(found, k, "_last"), F.col("anchor") == F.col("_a"), "left")
    last = F.transform("low", lambda x, w: F.coalesce(F.element_at("_last", w), x))
    again = searched(known.withColumn("last", last).drop("_a", "_last"), blocks, books, width, windows, k, same, first, True)
    return written(top(found.drop("rank").unionByName(again), k))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    codewords: int | None = None, sample: int = SAMPLE, first: int = FIRST,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) over rows (id, label, vector of whole numbers): for each anchor and each of its `positives` best rows of its label the first
    `negatives` rows of other labels whose score is between low and high per cent of the positive's."""
    spark = rows.sparkSession
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint, positive_rank int"
    rows = rows.select(F.col("id").cast("bigint"), F.col("label").cast("int"), F.col("vector").cast("array<int>")).where("label IS NOT NULL AND vector IS NOT NULL")
    sizes = rows.groupBy(F.size("vector").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    if sizes is None or not sizes["s"]:
        return spark.createDataFrame([], result)
    width = sizes["s"]
    rows = written(rows.where(F.size("vector") == width).select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "label", "vector"))
    blocks, books = indexed(rows, width, codewords, sample)
    anchors = rows.where(is_anchor & (F.col("id") != NO_ID)).distinct().withColumn("anchor", F.monotonically_increasing_id())
    anchors = written(anchors.select("anchor", "id", "label", "vector"))  # written, so that their numbers stay
    every = anchors.withColumns({"low": F.array(F.lit(LEAST + 1)), "high": F.array(F.lit(-LEAST))})
    near = search(every, blocks, books, width, 1, positives, True, first)
    scores = near.groupBy(F.col("anchor").alias("_a")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("_s"))
    spots = F.array(*[F.lit(i) for i in range(1, positives + 1)])
    ends = {
        "low": F.transform(spots, lambda i: F.coalesce(F.ceil(F.element_at("_s", i) * low / F.lit(100).cast("decimal(3,0)")).cast("bigint"), F.lit(1).cast("bigint"))),
        "high": F.transform(spots, lambda i: F.coalesce(F.floor(F.element_at("_s", i) * high / F.lit(100).cast("decimal(3,0)")).cast("bigint"), F.lit(0).cast("bigint"))),
    }
    windows = written(anchors.join(scores, F.col("anchor") == F.col("_a")).withColumns(ends).drop("_a", "_s"))
    far = search(windows, blocks, books, width, positives, negatives, False, first)
    out = far.select("anchor", (F.col("w") + 1).alias("positive_rank"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    pairs = near.select("anchor", F.col("rank").alias("positive_rank"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select("anchor", F.col("id").alias("anchor_id"))
    back = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    found = out.join(pairs, ["anchor", "positive_rank"]).join(names, "anchor")
    return found.select("anchor_id", back("positive_id"), F.col("rank").cast("int"), back("negative_id"), "positive_score", "negative_score", F.col("positive_rank").cast("int"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector among all vectors; every seventh vector has the next label."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select(F.col("vec_id").alias("id"), label.alias("label"), scaled(F.col("embedding")).alias("vector")), F.col("id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id)::INT AS positive_rank
  FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_rank ORDER BY score DESC, other_id)::INT AS rank, other_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
