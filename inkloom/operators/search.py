"""Hybrid search and research over a stated set of questions, as joins and windows over all of them at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.keys import cosine
from inkloom.functions.text import coverage, query_terms
from inkloom.models import Embedder, Reranker, hashed_embedding, overlap_reranker
from inkloom.operators import evidence, retrieval
from inkloom.operators.components import written

#: What makes a question complex for the relevance filter, and the words that a question's terms leave out.
COMPLEX = ("为什么", "原因", "动机", "时间线", "演变", "完整", "全过程", "结局", "影响", "意义")
STOPWORDS = ["的", "了", "吗", "呢", "和", "与", "中", "里", "是", "谁", "什么", "多少", "哪", "哪些", "请问", "小说"]


def hybrid(questions: DataFrame, points: DataFrame, collection: str = "chapters", embed: Embedder | None = None, rerank: Reranker = overlap_reranker, top: int | None = None) -> DataFrame:
    """(query_id, id, dense_score, sparse_score, fused_score, rerank_score, final_rank) for questions (query_id, book_id, query) over points (id, book_id, text).

    The pool is the dense top of each question's book; its points are scored again by token overlap, both ranks are fused, the best are reranked and padded in fused order. Points meet a
    question by an equality on the book as ids and vectors; only the pool's texts are fetched. A question has one row, and so has a point.
    """
    keep, pool, few = retrieval.LIMITS[collection]
    embed = embed or hashed_embedding()
    q = questions.select("query_id", F.col("book_id").alias("_book"), embed(F.col("query")).alias("_q"))
    met = points.select("id", "book_id", embed(F.col("text")).alias("_v")).join(q, F.col("book_id") == F.col("_book"))
    scored = met.select("query_id", "id", F.coalesce(cosine(F.col("_v"), F.col("_q")), F.lit(0.0)).alias("score"))
    # Ids and vectors are ranked; several branches read the pool, which is computed once and then gets its texts.
    best = written(scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= pool))
    asked = questions.select(F.col("query_id").alias("_asked"), "query")
    dense = written(points.select(F.col("id").alias("_id"), "text").join(best, F.col("_id") == F.col("id")).join(asked, F.col("query_id") == F.col("_asked")).drop("_id", "_asked"))
    fused = retrieval.fused(dense, retrieval.sparse(dense, few), keep)
    texts = dense.select("query_id", "id", "score", rerank(F.col("query"), F.col("text")).alias("rerank_score"))
    best = retrieval.reranked(fused, texts, top or keep)
    sparse = retrieval.sparse(dense, few).select("query_id", "id", "sparse_score")
    out = best.join(fused.select("query_id", "id", "fused_score"), ["query_id", "id"]).join(texts, ["query_id", "id"]).join(sparse, ["query_id", "id"], "left")
    return out.select("query_id", "id", F.col("score").alias("dense_score"), F.coalesce("sparse_score", F.lit(0.0)).alias("sparse_score"), "fused_score", "rerank_score", "final_rank")


def gap(first: Column, other: Column) -> Column:
    """How far a score lies below the first, as a share of it; null without one of them."""
    return F.when((F.abs(first) > 1e-6) & other.isNotNull(), F.greatest(F.lit(0.0), (first - other) / F.abs(first)))


def skips_rerank(question: Column, n: Column, first_text: Column, first: Column, second: Column, top: Column) -> Column:
    """Whether a result needs no reranking, and why: struct(skip, reason)."""
    answer = lambda skip, reason: F.struct(F.lit(skip).alias("skip"), F.lit(reason).alias("reason"))
    covered, near = coverage(query_terms(question, STOPWORDS), F.lower(F.trim(first_text))), gap(first, second)
    return (
        F.when(n == 0, answer(True, "no_candidates")).when(n == 1, answer(True, "skip_single_candidate")).when((n <= 3) & (top <= 3) & (covered >= 0.6), answer(True, "skip_rerank_small_precise_set"))
        .when((n <= 5) & (covered >= 0.7) & (near.isNull() | (near >= 0.18)), answer(True, "skip_rerank_high_coverage_gap")).otherwise(answer(False, "rerank_needed"))
    )


def wants_filter(question: Column, n: Column, first_text: Column, first: Column, second: Column, third: Column, mode: str = "auto") -> Column:
    """Whether a result goes through the relevance filter, and why: struct(run, reason)."""
    answer = lambda run, reason: F.struct(F.lit(run).alias("run"), F.lit(reason).alias("reason"))
    if mode in ("always", "never"):
        return answer(mode == "always", "llm_filtered_forced" if mode == "always" else "filter_skipped_never")
    covered = coverage(query_terms(question, STOPWORDS), F.lower(F.trim(first_text)))
    near, far = gap(first, second), gap(first, third)
    precise = (n <= 3) & (covered >= 0.6) & (near.isNull() | (near >= 0.2))
    certain = (covered >= 0.6) & (near >= 0.15) & (far.isNull() | (far >= 0.2))
    return (
        F.when(n == 0, answer(False, "empty_candidates")).when(n == 1, answer(False, "heuristic_skip_single_candidate")).when(question.rlike("|".join(COMPLEX)), answer(True, "auto_complex_query"))
        .when(precise, answer(False, "heuristic_skip_precise_small_set")).when(F.coalesce(certain, F.lit(False)), answer(False, "heuristic_skip_high_confidence_gap")).when(n >= 8, answer(True, "auto_large_candidate_set")).otherwise(answer(True, "auto_ambiguous_candidates"))
    )


def with_filter(hits: DataFrame, kept: DataFrame) -> DataFrame:
    """The hits that the filter keeps; all of a question's hits where it keeps none."""
    chosen = hits.join(kept.select("query_id", "id"), ["query_id", "id"], "left_semi")
    return retrieval.with_retry(chosen, hits)


def research(questions: DataFrame, chapters: DataFrame, **how) -> DataFrame:
    """(query_id, start, end, best_chapter, confidence, citations): for each question over its book's chapters (id, book_id, chapter_index, text) the window of the best cluster of found chapters, the chapter that best
    covers the question, how sure it is, and the first citations."""
    hits = hybrid(questions, chapters, **how).join(chapters.select("id", "chapter_index"), "id")
    found = hits.select("query_id", "chapter_index", F.lit("chapters").alias("source"), F.lit(None).cast("bigint").alias("plot_id"), F.lit(None).cast("bigint").alias("volume_id"), F.col("final_rank").alias("rank"), evidence.evidence_score(F.lit("chapters"), F.col("final_rank"), F.col("rerank_score"), F.col("fused_score")).alias("score"), F.lit(1).alias("tools"))
    by_question = found.withColumnRenamed("query_id", "book_id").groupBy("book_id", "chapter_index").agg(F.sum("score").alias("score"))
    windows = evidence.candidate_windows(evidence.clusters(by_question)).withColumnRenamed("book_id", "query_id")
    best = found.groupBy("query_id").agg(F.max_by("chapter_index", F.struct("score", -F.col("rank"))).alias("best_chapter"))
    return windows.join(best, "query_id").join(evidence.confidence(found, "query_id", "tools"), "query_id").join(evidence.citations(found, "query_id"), "query_id")
