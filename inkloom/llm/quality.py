"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs are hashed into BUCKETS buckets. Two multinomials are counted over them: the trusted target (documents labelled of
good quality and not toxic) and the raw corpus (all documents). A document's score is the mean, over its words and pairs, of
log p_target(bucket) - log p_raw(bucket) (smoothed), so it doesn't depend on length; a document is kept if it passes the base rules and its score
is at or above the threshold.

The raw counts cover every document. The target is fitted on `most_trusted` labelled documents at most (those with the smallest id hash), which bounds
what is broadcast; the table of scores has BUCKETS entries whatever the input's size.

What bounds a task's memory: one text with its words and their hashes, and the table of BUCKETS scores.

Defined cases: null texts have no words and fail the base rules; very long texts are judged whole; a score equal to the threshold is kept, and ties for the last trusted place go by id; a document with contradictory
labels is not trusted; without any
trusted document, or with an empty table, all scores are 0; repeated rows are counted and judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.llm.common import words, written

BUCKETS = 1 << 18
SMOOTH = 10.0
THRESHOLD = -0.2
MOST_TRUSTED = 50_000
SYMBOLS = r"[#*$%&|<>]"
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once even where functions over arrays refer to it for each element."""
    return F.transform(F.array(value), use)[0]


def joined(left: Column, right: Column) -> Column:
    """Hashes of left[i] with right[i + 1]: of word hashes the pairs', of pairs and words the 3-word windows'."""
    n = F.greatest(F.size(right) - 1, F.lit(0))
    return F.zip_with(F.slice(left, 1, n), F.slice(right, 2, n), lambda a, b: F.xxhash64(a, b))


def hashed(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def repeat_words(windows: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more, given the windows' hashes."""
    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    again = let(by_hash, lambda s: F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))))
    at = F.sort_array(F.transform(again, lambda x: x["i"]))
    # A window adds its words up to the next window's first; the last one adds all three (least() passes over the null).
    covered = let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)), F.lit(0).cast("bigint"), lambda a, n: a + n))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(covered)


def total(hashes: Column, weights: Column) -> Column:
    return F.aggregate(hashes, F.lit(0.0), lambda a, h: a + F.get(weights, bucket(h)))


def _judged(text: Column, weights: Column | None) -> Column:
    """A struct of the base features, and of the score if weights are given."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def fields(w: Column, h: Column, pairs: Column) -> Column:
        score = F.coalesce((total(h, weights) + total(pairs, weights)) / F.when(F.size(h) > 0, 2 * F.size(h) - 1), F.lit(0.0))
        again = let(joined(pairs, F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0)))), repeat_words)
        return F.struct(F.size(w).cast("bigint").alias("n_words"), F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), dup_lines.cast("bigint").alias("n_dup_lines"), again.alias("n_repeat_words"), score.alias("score"))

    return let(words(text), lambda w: let(hashed(w), lambda h: let(joined(h, h), lambda pairs: fields(w, h, pairs))))


def target_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """One row with an array of BUCKETS log ratios."""
    trusted = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 AND t = 0")
    trusted = trusted.orderBy(F.xxhash64("_id"), "_id").limit(most_trusted).select("_id", F.lit(1).alias("_target"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.join(F.broadcast(trusted), F.col("_doc") == F.col("_id"), "left")  # most_trusted rows at most
    grams = rows.select("_target", F.explode(let(hashed(words(F.col("_text"))), lambda h: F.concat(h, joined(h, h)))).alias("h"))
    counts = grams.groupBy(bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.count("_target").alias("target"))
    counts = written(docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("i")).join(counts, F.col("i") == F.col("b"), "left").select("i", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target")))
    all_raw, all_target = counts.agg(F.sum("raw"), F.sum("target")).first()
    # The target's counts are scaled to the raw corpus' size before smoothing: a bucket that neither favours weighs 0 whether rare or frequent.
    weight = F.log((F.col("target") * (all_raw / all_target) + SMOOTH) / (F.col("raw") + SMOOTH)) if all_target else F.lit(0.0)
    return counts.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", weight.alias("w")))), lambda x: x["w"]).alias("w"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, most_trusted: int = MOST_TRUSTED) -> DataFrame:
    """All rows and columns of `docs`, with a struct column _quality (in place of one of that name): the base features, score, base_failed and kept."""
    # The rows travel as one column, so their names can't clash. The scalar subquery's one row becomes a constant of the plan, without a join.
    rows = docs.select(F.struct("*").alias("row"), target_weights(docs, labels, id_col, text_col, most_trusted).scalar().alias("weights"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    rows = rows.select("row", let(F.col("weights"), lambda w: let(text, lambda t: _judged(t, w))).alias("q"))
    failed = (F.col("q.n_words") < 50) | (100 * F.col("q.n_repeat_words") > 50 * F.col("q.n_words"))
    kept = ~failed & (F.col("q.score") >= threshold)
    found = F.struct("q.*", failed.alias("base_failed"), kept.alias("kept")).alias("_quality")
    return rows.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "_quality"], found)


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The features and the verdict of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = quality(docs.select("doc_id", "text"), labels).select("doc_id", "_quality.*")
    return found.select("doc_id", *FEATURES, "base_failed", "kept", F.round("score", 6).alias("score"))
