"""Hybrid retrieval: dense top k, token overlap, rank fusion, reranking, vector sync."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.keys import cosine, reciprocal_ranks
from inkloom.functions.text import overlap_score, overlap_tokens

#: Results returned, dense pool and sparse pool of each collection, and the fusion's constant.
LIMITS = {"chapters": (25, 75, 100), "plots": (10, 25, 60), "volumes": (3, 5, 20), "characters": (8, 24, 48), "organisations": (8, 24, 48), "special_existences": (6, 20, 40), "world_rules": (6, 20, 40)}
RRF = 60


def dense(queries: DataFrame, points: DataFrame, most: int) -> DataFrame:
    """(query_id, id, score, rank): for each query its book's points of the largest cosine; ties by id.

    Queries (query_id, book_id, vector) are a stated set and meet the points of their book only; each task keeps the best of its rows before the shuffle.
    """
    q = queries.select("query_id", F.col("book_id").alias("_book"), F.col("vector").alias("_q"))
    rows = points.join(q, F.col("book_id") == F.col("_book"))
    scored = rows.select("query_id", "id", cosine(F.col("vector"), F.col("_q")).alias("score")).where("score IS NOT NULL")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= most)


def sparse(hits: DataFrame, most: int, query: str = "query", text: str = "text") -> DataFrame:
    """`hits` (query_id, id, query, text) rescored by token overlap: those that share a token, best first."""
    scored = hits.withColumn("sparse_score", overlap_score(overlap_tokens(F.col(query)), overlap_tokens(F.col(text)))).where("sparse_score > 0")
    order = Window.partitionBy("query_id").orderBy(F.desc("sparse_score"), "id")
    return scored.withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= most).select("query_id", "id", "sparse_score", "sparse_rank")


#: What the tokens of the questions of one pass may take, and how many counts and documents' tokens a task holds at a time.
MOST_BYTES, MOST_COUNTS, MOST_DOCUMENTS = 16 << 20, 200_000, 256


def overlap_topk(questions: DataFrame, documents: DataFrame, most: int, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(query_id, id, sparse_score, sparse_rank): for every question (query_id, query) the documents (id, text) that share most of its tokens, over all documents; ids are never null.

    Questions of `most_bytes` together at most are an inverted index in every task: a task counts shared tokens document by document and sends `most` documents a question at most. More questions meet the documents by a shuffle.
    """
    q = questions.select("query_id", overlap_tokens(F.col("query")).alias("tokens"))
    order = Window.partitionBy("query_id").orderBy(F.desc("sparse_score"), "id")
    size = q.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + F.octet_length(t) + 16))).first()[0] or 0
    if size > most_bytes:
        both = shared_tokens(q, documents)
    else:
        rows = q.where(F.size("tokens") > 0).toArrow()
        both = best_shared(documents, rows.column("query_id").to_pylist(), rows.column("tokens").to_pylist(), q.schema["query_id"].dataType.simpleString(), most)
    scored = both.select("query_id", "id", (F.col("n") / F.col("_all")).alias("sparse_score"))
    return scored.withColumn("sparse_rank", F.row_number().over(order)).where(F.col("sparse_rank") <= most)


def shared_tokens(q: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, id, _all, n): how many tokens every question (query_id, tokens) shares with every document, where they share any; counted before the shuffle, as a document's tokens lie in one task."""
    q = q.select("query_id", F.size("tokens").alias("_all"), F.explode("tokens").alias("_token"))
    d = documents.select("id", F.explode(overlap_tokens(F.col("text"))).alias("token"))
    return d.join(q, F.col("token") == F.col("_token")).groupBy("query_id", "id", "_all").agg(F.count(F.lit(1)).alias("n"))


def best_shared(documents: DataFrame, names: list, tokens: list[list[str]], kind: str, most: int) -> DataFrame:
    """The same of each task's `most` best documents for every question."""
    postings: dict[str, list[int]] = {}
    for n, own in enumerate(tokens):
        for t in own:
            postings.setdefault(t, []).append(n)
    index = {t: np.array(p, np.int32) for t, p in postings.items()}
    sizes = np.array([len(t) for t in tokens], np.int64)
    given = documents.sparkSession.sparkContext.broadcast((names, index, sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, index, sizes = given.value
        step = max(1, min(MOST_DOCUMENTS, MOST_COUNTS // max(1, len(names))))
        best = [np.zeros(0, np.int64)] * 3  # question, shared tokens, id
        least = np.ones(len(names), np.int64)
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(zero_copy_only=False), batch.column("tokens")
            for start in range(0, len(ids), step):
                some = lists.slice(start, step).to_pylist()
                counts = np.zeros((len(some), len(names)), np.int64)
                for row, own in enumerate(some):
                    found = [index[t] for t in own if t in index]
                    if found:
                        counts[row] = np.bincount(np.concatenate(found), minlength=len(names))
                rows, cols = np.nonzero(counts >= least)
                q, n, i = (np.concatenate([a, b]) for a, b in zip(best, (cols, counts[rows, cols], ids[start + rows])))
                order = np.lexsort((i, -n, q))
                q, n, i = q[order], n[order], i[order]
                first = np.searchsorted(q, q)  # where each question's rows begin
                kept = np.arange(len(q)) - first < most
                best = [q[kept], n[kept], i[kept]]
                held = np.bincount(best[0], minlength=len(names))
                last = np.cumsum(held) - 1
                least = np.where(held >= most, best[1][np.maximum(last, 0)] if len(best[1]) else 1, 1)
        q, n, i = best
        yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in q], QUERY_KINDS.get(kind, pa.string())), pa.array(i), pa.array(sizes[q]), pa.array(n)], ["query_id", "id", "_all", "n"])

    return documents.select("id", overlap_tokens(F.col("text")).alias("tokens")).mapInArrow(run, f"query_id {kind}, id bigint, _all bigint, n bigint")


QUERY_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def fused(dense_hits: DataFrame, sparse_hits: DataFrame, most: int) -> DataFrame:
    """(query_id, id, fused_score, fused_rank): both lists' points by the sum of their reciprocal ranks."""
    both = dense_hits.select("query_id", "id", F.col("rank").alias("dense_rank")).join(sparse_hits.select("query_id", "id", "sparse_rank"), ["query_id", "id"], "full")
    both = both.withColumn("fused_score", reciprocal_ranks(F.col("dense_rank"), F.col("sparse_rank"), k=RRF))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused_score"), "id")
    return both.withColumn("fused_rank", F.row_number().over(order)).where(F.col("fused_rank") <= most)


def reranked(fused_hits: DataFrame, scores: DataFrame, most: int) -> DataFrame:
    """(query_id, id, final_rank): the reranked points by score, then the others in fused order, `most` in all."""
    rows = fused_hits.join(scores.select("query_id", "id", "rerank_score"), ["query_id", "id"], "left")
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank_score"), "fused_rank")
    return rows.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= most).select("query_id", "id", "final_rank")


def with_retry(filtered: DataFrame, broad: DataFrame) -> DataFrame:
    """The filtered results, and the broad ones of the queries that the filter left without any."""
    return filtered.unionByName(broad.join(filtered.select("query_id").distinct(), "query_id", "left_anti"))


#: How many products a task of `sparse_dot` adds up.
MOST_PRODUCTS = 500_000


def summed(rows: DataFrame, keys: list[str], value: str, name: str, n: int) -> DataFrame:
    """The sums of `value` by keys of `n` rows, which few share: they are dealt by their keys over as many tasks as keep what one task adds up bounded."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // MOST_PRODUCTS))
    return rows.repartition(tasks, *keys).groupBy(*keys).agg(F.sum(value).alias(name))


def sparse_dot(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, dot) of sparse vectors as rows (id, index, value): an equality join on the index. Products are counted first and dealt by their pair over as many tasks as keep what one task holds bounded."""
    r = right.select(F.col("id").alias("right_id"), F.col("index").alias("_i"), F.col("value").alias("_v"))
    ours, theirs = left.groupBy("index").agg(F.count(F.lit(1)).alias("_n")), r.groupBy("_i").agg(F.count(F.lit(1)).alias("_m"))
    products = ours.join(theirs, F.col("index") == F.col("_i")).agg(F.sum(F.col("_n") * F.col("_m"))).first()[0] or 0
    pairs = left.join(r, F.col("index") == F.col("_i")).select(F.col("id").alias("left_id"), "right_id", (F.col("value") * F.col("_v")).alias("_product"))
    return summed(pairs, ["left_id", "right_id"], "_product", "dot", products)


def sync_plan(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, action) of wanted and stored points (id, hash): insert, update, skip or delete."""
    s = stored.select("id", F.col("hash").alias("_h"), F.lit(True).alias("_stored"))
    both = wanted.select("id", "hash", F.lit(True).alias("_wanted")).join(s, "id", "full")
    action = F.when(F.col("_wanted").isNull(), "delete").when(F.col("_stored").isNull(), "insert").when(F.col("hash").eqNullSafe(F.col("_h")), "skip").otherwise("update")
    return both.select("id", action.alias("action"))
