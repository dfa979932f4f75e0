"""Evidence: grounding in texts, scores, merging, clusters, windows, confidence, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.patterns import MOST_BYTES, counted, within_bound

#: What a source's evidence weighs, and the least confidence that it gives.
WEIGHTS = {"chapters": 1.0, "chapter_summaries_verify": 0.7, "chapter_summaries": 0.62, "plots": 0.72, "volumes": 0.55}
OTHER_WEIGHT = 0.65
ENTITIES = ("characters", "origanizations", "special_existences", "world_rules")
FLOORS = ((("chapters",), 0.9), (("chapter_summaries_verify",), 0.68), (("chapter_summaries",), 0.6), (("plots",), 0.62), (ENTITIES, 0.55))
NO_EVIDENCE = 0.18
SUMMARY_ONLY = ("chapter_summaries", "chapter_summaries_verify")
#: What a text says that is no evidence.
NEGATIVE = ("未提及", "未发现", "无相关", "没有提及", "无法确认", "证据不足", "不支持", "未在本次", "未找到")


def source_weight(source: Column) -> Column:
    out = F.lit(OTHER_WEIGHT)
    for name, weight in WEIGHTS.items():
        out = F.when(source == name, F.lit(weight)).otherwise(out)
    return out


def evidence_score(source: Column, rank: Column, *scores: Column) -> Column:
    """The first score there is (or one by rank), weighted by source; scores at or below 0 count as 1 / rank, rank 5 if unknown."""
    base = F.coalesce(*scores, F.when(rank > 0, 1.0 / rank), F.lit(0.0))
    return F.when(base <= 0, 1.0 / F.when(rank > 0, rank).otherwise(5)).otherwise(base) * source_weight(source)


#: The longest character runs on which short passages meet texts, and how many anchors of longer ones may go to every task as one constant.
GRAMS = (8, 4, 2, 1)
MOST_ANCHORS = 10_000


def contained(passages: DataFrame, texts: DataFrame, anchor: int = 4, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(item_id, doc_id): which texts contain which passages, as substrings. Null and empty passages are in no text.

    Passages of `most_bytes` together at most are found by one automaton in one pass over the texts. More of them meet the texts by a shuffle.
    """
    given = within_bound(passages, "passage", most_bytes)
    if given is None:
        return contained_by_runs(passages, texts, anchor)
    hits = counted(texts.select("doc_id", "text"), "text", given).select("doc_id", F.explode("hits").alias("_hit")).select("doc_id", F.col("_hit.pattern").alias("_p"))
    return hits.join(passages.select("item_id", "passage"), F.col("_p") == F.col("passage")).select("item_id", "doc_id").distinct()


def beginning() -> Column:
    """The longest of GRAMS that a passage has characters for."""
    return F.coalesce(*[F.when(F.length("passage") >= k, k) for k in GRAMS])


def begun(starts: DataFrame, passages: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(item_id, passage, doc_id, at): which of the passages (item_id, passage), all of k characters or more, stand in a text (doc_id, text) at one of its places (starts: doc_id, at, start, the k characters there).

    A place meets each beginning of passages once, however many passages share it, and learns their lengths; what stands there in each of these lengths then meets the passages as a whole.
    """
    heads = passages.groupBy(F.substring("passage", 1, k).alias("start")).agg(F.collect_set(F.length("passage")).alias("_lengths"))
    known = starts.join(heads, "start").select("doc_id", "at", F.explode("_lengths").alias("_n"))
    spelled = known.join(texts.select("doc_id", "text"), "doc_id").select("doc_id", "at", F.col("text").substr(F.col("at"), F.col("_n")).alias("passage"))
    return spelled.join(passages.select("item_id", "passage"), "passage").select("item_id", "passage", "doc_id", "at")


def contained_by_runs(passages: DataFrame, texts: DataFrame, anchor: int = 4) -> DataFrame:
    """The same for any number of passages.

    Both sides meet on equal hashes and only pairs that meet are searched. A passage of at least anchor + 2 words offers its words 2 to anchor + 1 (its first may begin inside a word), a text all its
    runs of that many words. A shorter passage offers its first characters, as many as the longest of GRAMS that it has, a text all its runs of that many characters; these are made
    only for the lengths that passages need, and passages of one beginning are told apart by `begun`. Up to MOST_ANCHORS anchors of words are a constant that sorts out texts before anything is exploded; more of them meet by a shuffle.
    """
    w = F.split(F.trim("passage"), r"\s+")
    given = passages.where("passage <> ''").withColumn("_w", w)
    long = given.where(F.size("_w") >= anchor + 2).select("item_id", "passage", F.xxhash64(F.array_join(F.slice("_w", 2, anchor), " ")).alias("_h"))
    runs = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - anchor + 1, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(t, i, F.lit(anchor)), " ")))
    # The words are bound once, or every run would split the text again.
    grams = texts.select("doc_id", "text", F.array_distinct(F.transform(F.array(F.split(F.trim("text"), r"\s+")), runs)[0]).alias("_g"))
    anchors = [r[0] for r in long.select("_h").distinct().limit(MOST_ANCHORS + 1).collect()]
    if len(anchors) <= MOST_ANCHORS:
        # A few of the texts stay, with their text.
        met = grams.select("doc_id", "text", F.array_intersect("_g", F.array(*map(F.lit, anchors)) if anchors else F.array().cast("array<bigint>")).alias("_g")).where(F.size("_g") > 0)
        found = met.select("doc_id", "text", F.explode("_g").alias("_g")).join(long, F.col("_g") == F.col("_h")).where(F.contains("text", "passage")).select("item_id", "doc_id")
    else:
        pairs = grams.select("doc_id", F.explode("_g").alias("_g")).join(long, F.col("_g") == F.col("_h")).select("doc_id", "item_id", "passage").distinct()
        found = pairs.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", "passage")).select("item_id", "doc_id")
    short = given.where(F.size("_w") < anchor + 2).select("item_id", "passage").withColumn("_k", beginning())
    for k in sorted(r[0] for r in short.select("_k").distinct().collect()):  # at most as many as GRAMS
        mine = short.where(F.col("_k") == k)
        places = F.sequence(F.lit(1), F.greatest(F.length("text") - k + 1, F.lit(1)))
        starts = texts.where(F.length("text") >= k).select("doc_id", F.explode(F.transform(places, lambda i: F.struct(i.alias("at"), F.substring(F.col("text"), i, F.lit(k)).alias("start")))).alias("s"))  # noqa: B023
        found = found.unionByName(begun(starts.select("doc_id", "s.at", "s.start"), mine, texts, k).select("item_id", "doc_id"))
    return found.distinct()


#: What makes two pieces of evidence one, besides the first characters of their snippet.
IDENTITY = ["source", "chapter_index", "plot_id", "volume_id", "start_chapter", "end_chapter", "source_name"]
SNIPPET = 120


def merged(evidence: DataFrame, scope: list[str]) -> DataFrame:
    """Evidence (scope, IDENTITY, snippet, score, ord, subquery_id) of one identity and one beginning of the snippet as one: the snippet of the highest score (the earliest by `ord` on ties), all subquery ids in order, how many; nth
    is its place by falling score, then by the place of the identity's first piece."""
    start = F.substring(F.coalesce("snippet", F.lit("")), 1, SNIPPET).alias("_start")
    rows = evidence.groupBy(*scope, *IDENTITY, start).agg(
        F.max("score").alias("score"), F.max_by("snippet", F.struct("score", -F.col("ord"))).alias("snippet"), F.array_join(F.array_sort(F.collect_set("subquery_id")), ",").alias("subquery_ids"),
        F.count(F.lit(1)).alias("n"), F.min("ord").alias("_first"),
    )
    nth = F.row_number().over(Window.partitionBy(*scope).orderBy(F.desc("score"), "_first", "_start"))
    return rows.withColumn("nth", nth.cast("bigint")).drop("_start", "_first")


def clusters(scores: DataFrame, gap: int = 2, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end, chapters, score): chapters of a key whose distance is at most `gap` make a cluster. Scores of one chapter are summed before anything is sorted."""
    keys = keys or ["book_id"]
    rows = scores.groupBy(*keys, "chapter_index").agg(F.sum("score").alias("score"))
    by = Window.partitionBy(*keys).orderBy("chapter_index")
    new = F.coalesce(F.col("chapter_index") - F.lag("chapter_index").over(by) > gap, F.lit(True))
    rows = rows.withColumn("_c", F.sum(new.cast("int")).over(by))
    return rows.groupBy(*keys, "_c").agg(F.min("chapter_index").alias("start"), F.max("chapter_index").alias("end"), F.count(F.lit(1)).alias("chapters"), F.sum("score").alias("score")).drop("_c")


def clipped(start: Column, end: Column, limit: int) -> tuple[Column, Column]:
    """A window from 1 on that spans `limit` chapters at most."""
    low = F.greatest(F.lit(1), start)
    return low, F.least(F.greatest(low, end), low + limit - 1)


def candidate_windows(found: DataFrame, limit: int = 8, keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end): each key's best cluster (the earliest of equal ones), clipped to `limit` chapters."""
    keys = keys or ["book_id"]
    best = found.groupBy(*keys).agg(F.max_by(F.struct("start", "end"), F.struct("score", -F.col("start"))).alias("w"))
    low, high = clipped(F.col("w.start"), F.col("w.end"), limit)
    return best.select(*keys, low.alias("start"), high.alias("end"))


def edge_windows(scores: DataFrame, edge: str = "first", keys: list[str] | None = None) -> DataFrame:
    """(keys, start, end): the earliest (or latest) found chapter with its neighbours, four chapters at most."""
    keys = keys or ["book_id"]
    at = F.col("_at")
    rows = scores.groupBy(*keys).agg((F.min if edge == "first" else F.max)("chapter_index").alias("_at"))
    low, high = clipped(at - 1, at + 1, 4)
    return rows.select(*keys, low.alias("start"), high.alias("end"))


def confidence(evidence: DataFrame, key: str, tools: str, keys: DataFrame | None = None) -> DataFrame:
    """(key, confidence): the best score, .95 at most and at least the floor of the best source; .03 more from four tools on. Keys of `keys` without evidence have NO_EVIDENCE."""
    floor = F.lit(0.0)
    for names, value in reversed(FLOORS):
        floor = F.when(F.bool_or(F.col("source").isin(*names)), F.lit(value)).otherwise(floor)
    found = evidence.groupBy(key).agg(F.greatest(F.least(F.lit(0.95), F.max("score")), floor).alias("c"), F.max(tools).alias("t"))
    found = found.select(key, F.round(F.when((F.col("t") >= 4) & (F.col("c") > 0.1), F.least(F.lit(0.95), F.col("c") + 0.03)).otherwise(F.col("c")), 3).alias("confidence"))
    if keys is None:
        return found
    found = found.withColumnRenamed(key, "_key")
    return keys.select(key).distinct().join(found, F.col(key).eqNullSafe(F.col("_key")), "left").select(key, F.coalesce("confidence", F.lit(NO_EVIDENCE)).alias("confidence"))


def negative(text: Column) -> Column:
    """Whether a text is no evidence: empty, or it says that nothing was found."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return (clean == "") | clean.rlike("|".join(NEGATIVE))


def without_summaries(evidence: DataFrame, windows: DataFrame) -> DataFrame:
    """`evidence` (subquery_id, source, chapter_index, ...) without what only summaries say inside its subquery's window (subquery_id, low, high), whose chapters have been read."""
    w = windows.select(F.col("subquery_id").alias("_s"), F.col("low").alias("_low"), F.col("high").alias("_high"))
    inside = (F.col("subquery_id") == F.col("_s")) & F.col("source").isin(*SUMMARY_ONLY) & F.col("chapter_index").between(F.col("_low"), F.col("_high"))
    return evidence.join(w, inside, "left_anti")


def coordinates(evidence: DataFrame, key: str) -> DataFrame:
    """(key, kind, place): the distinct chapters, plots and volumes that a key's evidence names."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("bigint").alias("place")) for k, c in (("chapter", "chapter_index"), ("plot", "plot_id"), ("volume", "volume_id"))])
    return evidence.select(key, F.explode(each).alias("c")).select(key, "c.kind", "c.place").where("place > 0").distinct()


def citations(evidence: DataFrame, key: str, most: int = 6) -> DataFrame:
    """(key, citations): the first distinct citation tokens by rank; the narrowest coordinate names an item."""
    token = F.coalesce(F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string")), F.concat(F.lit("Plot "), F.col("plot_id").cast("string")), F.concat(F.lit("Volume "), F.col("volume_id").cast("string")))
    firsts = evidence.withColumn("_t", token).where("_t IS NOT NULL").groupBy(key, "_t").agg(F.min("rank").alias("_r"))
    kept = firsts.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_r", "_t"))).where(F.col("_n") <= most)
    return kept.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "_t"))), lambda x: x["_t"]), "; ").alias("citations"))


def conflicts(evidence: DataFrame, key: str) -> DataFrame:
    """(key, conflicting): three or more chapters that span more than 40, or three or more plots without chapter text."""
    c, p = F.countDistinct("chapter_index"), F.countDistinct("plot_id")
    spread = (c >= 3) & (F.max("chapter_index") - F.min("chapter_index") > 40)
    return evidence.groupBy(key).agg(F.coalesce(spread | ((p >= 3) & ~F.bool_or(F.col("source") == "chapters")), F.lit(False)).alias("conflicting"))


def structured(batches: DataFrame, key: str, coverage: list[str]) -> DataFrame:
    """One row for each request of batch results (key, batch, status, hit_chapters, best_evidence, needs_fulltext, coverage flags): all hit chapters in order, any flag, the longest evidence (the first of
    equally long ones), how many batches hit."""
    text = F.trim(F.coalesce("best_evidence", F.lit("")))
    hits = F.array_sort(F.array_distinct(F.flatten(F.collect_list("hit_chapters"))))
    found = batches.groupBy(key).agg(
        hits.alias("hit_chapters"), F.max_by(text, F.struct(F.length(text), -F.col("batch"))).alias("best_evidence"), F.bool_or("needs_fulltext").alias("needs_fulltext"),
        F.count_if(F.upper("status") == "HIT").alias("matched_batches"), *[F.bool_or(c).alias(c) for c in coverage],
    )
    return found.withColumn("hit_count", F.size("hit_chapters")).withColumn("status", F.when(F.size("hit_chapters") > 0, "HIT").otherwise("MISS"))
