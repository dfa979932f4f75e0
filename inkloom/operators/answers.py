"""What becomes of evidence: refined questions, confirmed chapters, sections and packets of an answer, and when to search or to read on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import name_key
from inkloom.operators.evidence import clipped, negative

#: Words that refine no question, parts of those that report no finding, and what may part terms.
DULL = ("请", "确认", "核验", "提取", "围绕", "以下", "线索", "剧情", "内容", "相关", "章节", "原文", "依据", "故事", "问题", "本章", "本章节", "主要", "存在", "一种", "一个")
NOTHING = ("当前批次", "未提及任何", "无相关", "证据不足")
BREAKS = r"[\s，,。；;：:、!?？（）()<>《》【】\[\]\\-]+"
#: How many chapters confirm a part of each intent, and the intents that go to the full text.
CONFIRMED = {"existence_check": 1, "first_appearance": 1, "timeline_evolution": 3}
DIRECT = ("first_appearance", "ending_fate", "quote_micro_detail")
QUOTING = ("原文", "原话", "对白", "逐字")
#: What sends a chat message to the search, keeps it from it, and asks for the last search again.
SEARCH = ("谁", "什么", "为什么", "为何", "过程", "剧情", "身份", "能力", "背景", "结局", "最后", "章节", "原文", "对白", "关系", "出现", "是不是", "有没有")
CASUAL = ("你好", "谢谢", "再见", "在吗", "你是谁", "帮我", "总结一下聊天")
AGAIN = ("重新搜索", "重新检索", "重新搜", "重搜", "重查", "重新查", "记忆是错的", "记忆错了", "你记错了", "回答错了", "不是这个", "上一轮", "上一题", "上一个问题", "刚才那个问题")
#: What an answer says where evidence is missing, and its headings.
UNRESOLVED, NOTHING_FOUND, NOT_ENOUGH = "证据不足，暂时无法稳定回答这一子问题。", "未找到可回答问题的稳定证据。", "未能获得足够稳定的章节级证据来完整回答该问题。"
#: The first record of an edge is worth so much, each further one less, down to the least; what hits in summaries and chapters and directory lines are worth.
EDGE_BEST, EDGE_STEP, EDGE_LEAST = 0.86, 0.04, 0.72
STRUCTURED = {"chapters": 0.95, "chapter_summaries_verify": 0.66, "chapter_directory": 0.7}


def distinct_terms(terms: Column, most: int) -> Column:
    """The first `most` terms of different keys (blanks and case aside)."""
    keyed = F.transform(F.array(F.filter(F.transform(terms, lambda x: F.struct(F.trim(x).alias("x"), name_key(x).alias("k"))), lambda s: s["k"] != "")), lambda all_: F.filter(all_, lambda s, i: F.array_position(F.transform(all_, lambda y: y["k"]), s["k"]) == i + 1))[0]
    return F.slice(F.transform(keyed, lambda s: s["x"]), 1, most)


def refinement_terms(text: Column, most: int = 6) -> Column:
    """The terms of a text that may refine a question: between breaks, of 2 to 16 characters, no dull ones."""
    found = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), BREAKS), lambda x: F.trim(x)), lambda x: F.length(x).between(2, 16) & ~x.isin(*DULL) & ~x.rlike("|".join(NOTHING)))
    return distinct_terms(found, most)


def theme_overlap(term: Column, anchor: Column) -> Column:
    """The share of the anchor's characters that a term has too."""
    letters = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", ""), ""), lambda x: x != ""))
    return F.transform(F.array(letters(anchor)), lambda a: F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(letters(term), a)) / F.greatest(F.size(a), F.lit(1))))[0]


def refined(question: Column, entity_query: Column, names: Column, snippets: Column) -> Column:
    """struct(entity_query, plot_query, chapter_query, terms) of a question after its first three pieces of evidence: their names and terms that are near the question's longest term join its own."""
    base = refinement_terms(entity_query, 6)
    near = lambda anchor: lambda x: theme_overlap(x, anchor) >= 0.34

    def whole(b: Column) -> Column:
        anchor = F.aggregate(b, F.lit(""), lambda a, x: F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))) > F.length(F.replace(a, F.lit(" "), F.lit(""))), x).otherwise(a))
        anchor = F.when(F.size(b) == 0, question).otherwise(anchor)
        found = F.flatten(F.zip_with(F.slice(names, 1, 3), F.slice(snippets, 1, 3), lambda n, s: F.concat(F.array(F.coalesce(n, F.lit(""))), refinement_terms(s, 3))))
        terms = distinct_terms(F.concat(b, F.filter(found, near(anchor))), 8)
        few = F.slice(terms, 1, 4)
        bare = F.regexp_replace(question, "[？?。]+$", "")
        return F.struct(F.array_join(distinct_terms(F.concat(b, few), 8), " ").alias("entity_query"), F.array_join(distinct_terms(F.concat(b, terms), 10), " ").alias("plot_query"), F.concat(bare, F.lit(" 请重点核验以下线索："), F.array_join(few, "、"), F.lit("。")).alias("chapter_query"), terms.alias("terms"))

    return F.transform(F.array(base), whole)[0]


def edge_scores(records: DataFrame, edge: str = "first") -> DataFrame:
    """`records` (query_id, chapter_index) with source, nth and score: nearest to the edge first."""
    order = Window.partitionBy("query_id").orderBy(F.col("chapter_index").desc() if edge == "last" else F.col("chapter_index").asc())
    rows = records.where("chapter_index > 0").withColumn("nth", F.row_number().over(order).cast("bigint"))
    return rows.withColumn("source", F.lit(f"entity_edge_{edge}")).withColumn("score", F.round(F.greatest(F.lit(EDGE_LEAST), F.lit(EDGE_BEST) - (F.col("nth") - 1) * EDGE_STEP), 6))


def structured_evidence(results: DataFrame, source: str) -> DataFrame:
    """(query_id, source, chapter_index, snippet, score) of results (query_id, hit_chapters, best_evidence): a row for each hit, if there is evidence."""
    rows = results.where("trim(coalesce(best_evidence, '')) <> ''").select("query_id", F.lit(source).alias("source"), F.explode("hit_chapters").alias("chapter_index"), F.trim("best_evidence").alias("snippet"))
    return rows.where("chapter_index > 0").withColumn("score", F.lit(STRUCTURED[source]))


def directory_evidence(listings: DataFrame) -> DataFrame:
    """(query_id, source, chapter_index, snippet, score) of directory texts (query_id, text): every chapter that is named after `chapter_index`."""
    found = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(?i)chapter_index\D+(\d+)"), F.lit(1)), lambda x: x.cast("bigint")))
    return listings.select("query_id", F.lit("chapter_directory").alias("source"), F.explode(found).alias("chapter_index"), F.substring(F.trim("text"), 1, 320).alias("snippet"), F.lit(STRUCTURED["chapter_directory"]).alias("score"))


def validation_windows(evidence: DataFrame) -> DataFrame:
    """`evidence` (intent, chapter_index, start_chapter, end_chapter, low, high) with the window to read before it is trusted: its chapter (with neighbours for reasons and courses), the first three of its range, else its part's own window."""
    around = F.when(F.col("intent").isin("timeline_evolution", "causal_motivation"), 1).otherwise(0)
    a, z = clipped(F.col("chapter_index") - around, F.col("chapter_index") + around, 3)
    b, y = clipped(F.col("start_chapter"), F.least(F.col("end_chapter"), F.col("start_chapter") + 2), 3)
    own, ranged = F.col("chapter_index") > 0, (F.col("start_chapter") > 0) & (F.col("end_chapter") > 0)
    return evidence.withColumn("window_start", F.when(own, a).when(ranged, b).otherwise(F.col("low"))).withColumn("window_end", F.when(own, z).when(ranged, y).otherwise(F.col("high")))


def confirmed(evidence: DataFrame, chapters: DataFrame) -> DataFrame:
    """(subquery_id, chapter_index, claim, excerpt, confidence, nth) of evidence (subquery_id, book_id, intent, source, chapter_index, snippet, score, rank): of each part the first chapters, as many as its intent
    needs, whose full text says something; the excerpt is the chapter's text (chapters: book_id, chapter_index, content)."""
    good = evidence.where((F.col("source") == "chapters") & (F.col("chapter_index") > 0) & ~negative(F.col("snippet")))
    first = good.groupBy("subquery_id", "book_id", "intent", "chapter_index").agg(F.min_by(F.struct("snippet", "score", "rank"), "rank").alias("e"))
    order = Window.partitionBy("subquery_id").orderBy("e.rank")
    most = F.lit(2)
    for kind, n in CONFIRMED.items():
        most = F.when(F.col("intent") == kind, n).otherwise(most)
    kept = first.withColumn("nth", F.row_number().over(order).cast("bigint")).where(F.col("nth") <= most)
    texts = chapters.select(F.col("book_id").alias("_b"), F.col("chapter_index").alias("_c"), "content")
    rows = kept.join(texts, (F.col("book_id") == F.col("_b")) & (F.col("chapter_index") == F.col("_c")), "left")
    return rows.select("subquery_id", "chapter_index", F.col("e.snippet").alias("claim"), F.coalesce(F.nullif(F.trim("content"), F.lit("")), "e.snippet").alias("excerpt"), F.col("e.score").alias("confidence"), "nth")


def needs_fulltext(kind: Column, has_summary: Column, sure: Column, question: Column) -> Column:
    """Whether a part must be read in full: by its intent, its words, because summaries only show where to look, or as it is not sure enough."""
    return kind.isin(*DIRECT) | F.coalesce(question, F.lit("")).rlike("|".join(QUOTING)) | has_summary | (kind.isin("causal_motivation", "timeline_evolution") & (sure < 0.82)) | (sure < 0.72)


def skips_summaries(kind: Column, low: Column, high: Column) -> Column:
    """Whether a part goes past the summaries: one of the direct intents, over at most three chapters."""
    span = F.greatest(F.lit(0), high - low + 1)
    return F.coalesce(kind.isin(*DIRECT) & (span > 0) & (span <= 3), F.lit(False))


def recovery(resolved: Column, n: Column, sure: Column, conflicting: Column, tool_calls: Column, windows: Column) -> Column:
    """struct(enter, reason): whether a part is searched for once more, with so many calls and windows left."""
    answer = lambda enter, reason: F.struct(F.lit(enter).alias("enter"), F.lit(reason).alias("reason"))
    return (
        F.when(resolved, answer(False, "already_resolved")).when(tool_calls <= 0, answer(False, "global_tool_budget_exhausted")).when(windows < 0, answer(False, "global_fulltext_budget_exhausted"))
        .when(n == 0, answer(True, "no_chapter_evidence")).when(sure < 0.78, answer(True, "low_confidence")).when(conflicting, answer(True, "conflicting_evidence")).otherwise(answer(False, "not_needed"))
    )


def sections(parts: DataFrame) -> DataFrame:
    """`parts` (query_id, subquery_id, label, resolved, snippets, citations) with status, conclusion and text of each part's section."""
    shown = F.slice(F.filter(F.coalesce("snippets", F.array().cast("array<string>")), lambda s: F.trim(s) != ""), 1, 2)
    rows = parts.withColumn("_shown", shown).withColumn("status", F.when(F.col("resolved"), "resolved").otherwise("unresolved"))
    done = F.col("status") == "resolved"
    rows = rows.withColumn("conclusion", F.when(done & (F.size("_shown") > 0), F.get("_shown", F.lit(0))).otherwise(UNRESOLVED))
    support = F.when(~done & (F.size("_shown") > 0), F.get("_shown", F.lit(0))).when(F.size("_shown") > 1, F.get("_shown", F.lit(1)))
    line = lambda head, c: F.when(c.isNotNull(), F.concat(F.lit(head), c))
    cited = F.nullif(F.array_join(F.slice(F.coalesce("citations", F.array().cast("array<string>")), 1, 6), ", "), F.lit(""))
    text = F.concat_ws("\n", F.concat(F.col("label"), F.lit("：")), "conclusion", line("补充依据：", support), line("定位：", cited), F.when(~done, "状态：证据不足"))
    return rows.withColumn("text", text).drop("_shown")


def answers(found: DataFrame) -> DataFrame:
    """(query_id, summary, answer) of a question's sections (query_id, subquery_id, label, status, text)."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("subquery_id", F.col(c).alias("x")))), lambda s: s["x"])
    rows = found.groupBy("query_id").agg(F.array_join(F.transform(F.filter(F.sort_array(F.collect_list(F.struct("subquery_id", "status", "label"))), lambda s: (s["status"] == "resolved") & (s["label"] != "")), lambda s: s["label"]), "、").alias("labels"), F.bool_and(F.col("status") == "resolved").alias("all"), F.bool_or(F.col("status") == "resolved").alias("any"), F.array_join(ordered("text"), "\n\n").alias("body"))
    summary = F.when(~F.col("any"), NOT_ENOUGH).when(~F.col("all"), F.concat(F.lit("已就"), "labels", F.lit("获得阶段性结论，但仍有部分子问题证据不足。"))).otherwise(F.concat(F.lit("已完成对"), "labels", F.lit("的检索与证据整合。")))
    return rows.select("query_id", summary.alias("summary"), F.concat(F.lit("总述："), summary, F.lit("\n\n"), "body").alias("answer"))


def packets(evidence: DataFrame, confirmed: DataFrame | None = None, grounding: DataFrame | None = None, most: int = 4, chars: int = 320, hits: int = 8, sure: int = 6) -> DataFrame:
    """(query_id, evidence, confirmed, chapter_hits, plot_hits, volume_hits, grounding): what a search hands on, kept short.

    evidence: (query_id, rank, source, chapter_index, plot_id, volume_id, source_name, snippet, score): the first four pieces, their snippets cut, and the first eight places of each kind in order of rank, repeated ones too;
    confirmed: (query_id, subquery_id, label, chapter_index, source_name, claim, excerpt, confidence, nth): the first six by part and place; grounding: (query_id, applied, entity_type, source_ids, reason, selected): with eight ids and
    three chosen names at most.
    """
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    ordered = lambda c, keep: F.slice(F.transform(F.sort_array(F.collect_list(c)), lambda x: x["v"]), 1, keep)
    places = {c: f"_n_{c}" for c in ("chapter_index", "plot_id", "volume_id")}
    rows = evidence.withColumn("_n", F.row_number().over(by_rank))
    # Of each kind only the first few are gathered.
    rows = rows.withColumns({n: F.count(F.when(F.col(c) > 0, 1)).over(by_rank.rowsBetween(Window.unboundedPreceding, 0)) for c, n in places.items()})
    few = F.struct("source", "chapter_index", "plot_id", "volume_id", F.coalesce("source_name", F.lit("")).alias("source_name"), F.substring(F.coalesce("snippet", F.lit("")), 1, chars).alias("snippet"), "score")
    first = lambda c: ordered(F.when((F.col(c) > 0) & (F.col(places[c]) <= hits), F.struct("_n", F.col(c).alias("v"))), hits)
    out = rows.groupBy("query_id").agg(
        ordered(F.when(F.col("_n") <= most, F.struct("_n", few.alias("v"))), most).alias("evidence"), first("chapter_index").alias("chapter_hits"), first("plot_id").alias("plot_hits"), first("volume_id").alias("volume_hits")
    )
    if confirmed is not None:
        good = F.struct("subquery_id", F.coalesce("label", F.lit("")).alias("label"), "chapter_index", F.coalesce("source_name", F.lit("")).alias("source_name"), F.coalesce("claim", F.lit("")).alias("claim"), F.coalesce("excerpt", F.lit("")).alias("excerpt"), "confidence")
        kept = confirmed.withColumn("_k", F.row_number().over(Window.partitionBy("query_id").orderBy("subquery_id", "nth"))).where(F.col("_k") <= sure)
        lists = kept.groupBy(F.col("query_id").alias("_q")).agg(ordered(F.struct("_k", good.alias("v")), sure).alias("confirmed"))
        out = out.join(lists, F.col("query_id") == F.col("_q"), "left").drop("_q")
    if grounding is not None:
        short = F.struct(F.coalesce("applied", F.lit(False)).alias("applied"), F.coalesce("entity_type", F.lit("")).alias("entity_type"), F.slice("source_ids", 1, hits).alias("source_ids"), F.coalesce("reason", F.lit("")).alias("reason"), F.slice("selected", 1, 3).alias("selected"))
        out = out.join(grounding.select(F.col("query_id").alias("_g"), short.alias("grounding")), F.col("query_id") == F.col("_g"), "left").drop("_g")
    return out


def searches(text: Column) -> Column:
    """Whether a chat message must be searched for."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    return (clean != "") & ~clean.rlike("|".join(CASUAL)) & (clean.rlike("|".join(SEARCH)) | clean.rlike("[？?]$"))


def asks_again(text: Column) -> Column:
    """Whether a chat message asks for the last search once more: short, and it says so."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", "")
    return F.length(clean).between(1, 32) & clean.rlike("|".join(AGAIN))


def chat_questions(messages: DataFrame) -> DataFrame:
    """(session_id, message_id, question) of the user's messages (session_id, message_id, role, content): the message itself, or if it asks again, the latest one before it that does not."""
    own = F.trim(F.coalesce("content", F.lit("")))
    rows = messages.where("role = 'user'").select("session_id", "message_id", own.alias("content"))
    before = Window.partitionBy("session_id").orderBy("message_id").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when((F.col("content") != "") & ~asks_again(F.col("content")), F.col("content")), ignorenulls=True).over(before)
    return rows.withColumn("_last", last).select("session_id", "message_id", F.when(asks_again(F.col("content")), F.coalesce("_last", "content")).otherwise(F.col("content")).alias("question"))


def style_samples(question: Column, samples: Column, most: int = 4) -> Column:
    """The samples (array<struct<scene, quote>>) nearest to a question: two points if its scene has the question or one of its words, one if its quote has; ties by scene and quote."""
    words = F.filter(F.array_distinct(F.concat(F.array(F.trim(question)), F.split(F.trim(question), r"\s+"))), lambda w: w != "")
    has = lambda c: (F.coalesce(c, F.lit("")) != "") & F.exists(words, lambda w: F.contains(c, w))
    scored = F.array_sort(F.transform(samples, lambda s: F.struct((-(F.when(has(s["scene"]), 2).otherwise(0) + F.when(has(s["quote"]), 1).otherwise(0))).alias("worse"), s["scene"].alias("scene"), s["quote"].alias("quote"))))
    return F.slice(F.transform(scored, lambda s: F.struct(s["scene"].alias("scene"), s["quote"].alias("quote"))), 1, most)
