"""Relation events: merged histories, groups, scores, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.text import name_key
from inkloom.operators.evidence import contained_by_runs
from inkloom.operators.patterns import MOST_BYTES, counted, within_bound
from inkloom.operators.profiles import chosen_chapters, excerpts

KIND = ["relation_type", "polarity", "strength"]


def islands(events: DataFrame, keys: list[str]) -> DataFrame:
    """Histories of `events` (keys, chapter_start, chapter_end, relation_type, polarity, strength, summary).

    In order of start, end, type, polarity, strength and summary, neighbouring rows of one kind are one entry as long as each begins at the latest a chapter after what the entry
    has reached. Result: keys, island, kind, chapter_start, chapter_end, n_events, first_summary.
    """
    # Events that differ in their summary only are neighbours of one kind: they are one row before anything is sorted.
    order = [F.col(c) for c in ("chapter_start", "chapter_end", *KIND)]
    events = events.groupBy(*keys, "chapter_start", "chapter_end", *KIND).agg(F.count(F.lit(1)).alias("_events"), F.min("summary").alias("summary"))
    by = Window.partitionBy(*keys).orderBy(*order)
    other = F.lit(False)
    for c in KIND:
        other = other | ~F.lag(c).over(by).eqNullSafe(F.col(c))
    rows = events.withColumn("_n", F.row_number().over(by)).withColumn("_run", F.sum(other.cast("int")).over(by))
    # What an entry has reached is the largest end in its run so far: an entry of the run that ended earlier ends before the next one begins.
    in_run = Window.partitionBy(*keys, "_run").orderBy("_n")
    reached = F.max("chapter_end").over(in_run.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_new", F.coalesce(F.col("chapter_start") > reached + 1, F.lit(True)).cast("int"))
    rows = rows.withColumn("island", F.sum("_new").over(by))
    return rows.groupBy(*keys, "island").agg(*[F.first(c).alias(c) for c in KIND], F.min("chapter_start").alias("chapter_start"), F.max("chapter_end").alias("chapter_end"), F.sum("_events").alias("n_events"), F.min_by("summary", "_n").alias("first_summary"))


def grouped(events: DataFrame) -> DataFrame:
    """One row for each name key of `events` (ord, target_id, target_name, chapter_start, chapter_end): the first positive id, the first name with an id or else the first name, bounds."""
    key = F.lower(F.regexp_replace("target_name", r"(?U)\s+", ""))
    with_id = F.when(F.col("target_id") > 0, F.col("ord"))
    return events.withColumn("name_key", key).groupBy("name_key").agg(
        F.coalesce(F.min_by("target_id", with_id), F.lit(0)).alias("target_id"), F.coalesce(F.min_by("target_name", with_id), F.min_by("target_name", "ord")).alias("target_name"),
        F.min("chapter_start").alias("chapter_start"), F.max("chapter_end").alias("chapter_end"), F.count(F.lit(1)).alias("n_events"),
    )


def deduped(rows: DataFrame) -> DataFrame:
    """Relation rows of one (source, target) as one: unions of lists, first non-empty scalars by order, bounds."""
    first = lambda c: F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col("ord")))
    return rows.groupBy("source_id", "target_id").agg(*[first(c).alias(c) for c in KIND], F.array_sort(F.collect_set("chapter_start")).alias("chapters"), F.min("chapter_start").alias("chapter_start"), F.max("chapter_end").alias("chapter_end"))


def stored_rows(rows: DataFrame, lists: list[str], firsts: list[str]) -> DataFrame:
    """(source_id, name_key, target_id, target_name, summary, lists, firsts, first_chapter, last_chapter, history) of relation rows (source_id, ord, target_id, target_name, summary, lists, firsts, history) as they are stored: one for
    each source and name of a target (blanks and case aside).

    The target is the first with an id, else the first; summaries are joined, each once; lists are united in order, each entry trimmed, once and not empty; of `firsts` the first that isn't blank counts. Histories (arrays of
    chapter_start, chapter_end, relation_type, polarity, strength, summary) are merged as `islands` does, over all rows of the target at once; without any, the chapters are 0.
    """
    keys = ["source_id", "name_key"]
    rows = rows.withColumn("name_key", name_key(F.coalesce("target_name", F.lit("")))).where("name_key <> ''")
    # An entry of a list counts where it is first: so lists are united without a row's list being carried past that.
    none = F.array().cast("array<string>")

    def elements(c: str) -> Column:
        given = F.array("summary") if c == "summary" else F.col(c)
        return F.transform(F.coalesce(given, none), lambda x, i: F.struct(F.lit(c).alias("list"), F.trim(x).alias("entry"), i.alias("i")))

    entries = rows.select(*keys, "ord", F.explode(F.concat(*[elements(c) for c in ["summary", *lists]])).alias("e")).where("coalesce(e.entry, '') <> ''")
    once = entries.groupBy(*keys, "e.list", "e.entry").agg(F.min(F.struct("ord", "e.i")).alias("at"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("list") == c, F.struct("at", "entry")))), lambda x: x["entry"])
    united = once.groupBy(*keys).agg(*[listed(c).alias(c) for c in ["summary", *lists]])
    with_id, filled = F.when(F.col("target_id") > 0, F.col("ord")), lambda c: F.when(F.coalesce(F.trim(F.col(c)), F.lit("")) != "", F.col("ord"))
    heads = rows.groupBy(*keys).agg(
        F.coalesce(F.min_by("target_id", with_id), F.lit(0)).alias("target_id"), F.coalesce(F.min_by("target_name", with_id), F.min_by("target_name", "ord")).alias("target_name"),
        *[F.coalesce(F.min_by(F.trim(F.col(c)), filled(c)), F.lit("")).alias(c) for c in firsts],
    )
    events = islands(rows.select(*keys, F.explode("history").alias("h")).select(*keys, "h.*"), keys)
    entry = F.struct("island", "chapter_start", "chapter_end", *KIND, F.col("first_summary").alias("summary"))
    merged = events.groupBy(*keys).agg(F.min("chapter_start").alias("first_chapter"), F.max("chapter_end").alias("last_chapter"), F.array_sort(F.collect_list(entry)).alias("history"))
    out = heads.join(united, keys, "left").join(merged, keys, "left")
    return out.select(*keys, "target_id", "target_name", F.array_join(F.coalesce("summary", none), "；").alias("summary"), *[F.coalesce(c, none).alias(c) for c in lists], *firsts, F.coalesce("first_chapter", F.lit(0)).alias("first_chapter"), F.coalesce("last_chapter", F.lit(0)).alias("last_chapter"), "history")


def emotion_scores(candidates: DataFrame, keys: list[str], least: int = 3) -> DataFrame:
    """The sum over candidates of intensity (high 3, medium 2, other 1) and confidence (high 1, low 0, other 1); groups of `least` and more stay."""
    intensity = F.when(F.col("intensity") == "high", 3).when(F.col("intensity") == "medium", 2).otherwise(1)
    confidence = F.when(F.col("confidence") == "low", 0).otherwise(1)
    return candidates.groupBy(*keys).agg(F.sum(intensity + confidence).alias("score"), F.count(F.lit(1)).alias("n"), F.min("chapter_start").alias("chapter_start"), F.max("chapter_end").alias("chapter_end")).where(F.col("score") >= least)


def overlapping(segments: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """(segment_id, group_id): for each segment the groups of its key whose interval it overlaps; without any, the key's last group (by start, id)."""
    g = groups.select(F.col(key).alias("_k"), "group_id", F.col("start").alias("_a"), F.col("end").alias("_z"))
    s = segments.select(key, "segment_id", "start", "end")
    met = s.join(g, (F.col(key) == F.col("_k")) & (F.col("start") <= F.col("_z")) & (F.col("_a") <= F.col("end"))).select("segment_id", "group_id")
    last = groups.groupBy(F.col(key).alias("_k")).agg(F.max_by("group_id", F.struct("start", "group_id")).alias("group_id"))
    alone = s.join(met.select("segment_id"), "segment_id", "left_anti").join(last, F.col(key) == F.col("_k")).select("segment_id", "group_id")
    return met.unionByName(alone)


def style_counts(samples: DataFrame) -> DataFrame:
    """(signal, occurrences) of `samples` (signal, ord): signals by a key without blanks and case, shown as first seen; the most frequent first, equally frequent ones by their text."""
    shown = F.trim("signal")
    found = samples.withColumn("_key", name_key(shown)).where("_key <> ''").groupBy("_key").agg(F.min_by(shown, "ord").alias("signal"), F.count(F.lit(1)).alias("occurrences"))
    return found.orderBy(F.desc("occurrences"), "signal").select("signal", "occurrences")


def style_scenes(samples: DataFrame, most: int = 30) -> DataFrame:
    """(scene, quote, occurrences) of `samples` (scene, quote, ord): pairs without an empty side, by a key without blanks and case, shown as first seen; the `most` most frequent, equally frequent ones by scene and quote."""
    clean = samples.select(F.trim(F.coalesce("scene", F.lit(""))).alias("scene"), F.trim(F.coalesce("quote", F.lit(""))).alias("quote"), "ord").where("scene <> '' AND quote <> ''")
    found = clean.groupBy(name_key(F.concat_ws("|", "scene", "quote")).alias("_key")).agg(F.min_by(F.struct("scene", "quote"), "ord").alias("s"), F.count(F.lit(1)).alias("occurrences"))
    return found.select("s.scene", "s.quote", "occurrences").orderBy(F.desc("occurrences"), "scene", "quote").limit(most)


#: What keyword groups score in a chapter that mentions the other side, and the reason that each gives.
RELATION_WORDS = (
    (6, ("救", "杀", "打", "护", "骗", "威胁", "命令", "联手", "交易", "安慰", "表白", "利用", "怀疑", "保护"), "存在明确互动"),
    (5, ("合作", "翻脸", "决裂", "和解", "确认关系", "互相怀疑", "建立信任", "依赖", "疏远", "亲近"), "关系变化信号"),
    (4, ("信任", "依赖", "厌恶", "恐惧", "爱慕", "警惕", "尊敬", "嫉妒", "愧疚", "关心"), "情感指向明确"),
    (4, ("父", "母", "兄", "姐", "弟", "妹", "师", "徒", "同学", "队友", "上司", "下属", "夫妻", "恋人", "朋友"), "结构关系线索"),
)
EVIDENCE, TWICE, STARTS, ENDS, CONTEXT = "已识别关系证据", "双向提及概率较高", "本卷关系起点", "本卷关系终点", "邻接上下文"


def normalised(events: DataFrame, windows: DataFrame) -> DataFrame:
    """Model events (window_id, source, target, start, end, relation_type, polarity, strength, summary, evidence) held within their window (window_id, low, high).

    Events of a character with itself or with nobody are left out; a missing start is the window's, an end before the start is the start; polarity and strength have defaults; evidence
    outside the event is left out, and the start stands in for none.
    """
    key = lambda c: F.lower(F.regexp_replace(c, r"(?U)\s+", ""))
    text = lambda c, other: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(other)).alias(c)
    rows = events.join(windows, "window_id").where((F.coalesce(F.trim("target"), F.lit("")) != "") & (key("target") != key("source")))
    rows = rows.withColumn("start", F.greatest("low", F.coalesce("start", "low")))
    rows = rows.withColumn("end", F.least("high", F.greatest("start", F.coalesce("end", "start"))))
    inside = F.array_distinct(F.filter("evidence", lambda c: c.between(F.col("start"), F.col("end"))))
    evidence = F.when(F.size(inside) > 0, inside).otherwise(F.array("start"))
    return rows.select("window_id", "source", "target", "start", "end", text("relation_type", ""), text("polarity", "neutral"), text("strength", "medium"), text("summary", ""), evidence.alias("evidence"))


def alias_sets(aliases: DataFrame) -> DataFrame:
    """(target, names): every target's name and aliases (target, aliases), trimmed, each once and none empty."""
    return aliases.select("target", F.array_distinct(F.filter(F.transform(F.concat(F.array("target"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda a: F.trim(a)), lambda a: a != "")).alias("names"))


def with_hits(entries: DataFrame, names: DataFrame, words=RELATION_WORDS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """`entries` (keys, text) with groups (which keyword groups the text has) and hits (how often each name is in it) in place of the text: each text is gone over once for all names."""
    rows = entries.withColumn("groups", F.array(*[F.coalesce(F.col("text").rlike("|".join(w)), F.lit(False)) for _, w, _ in words]))
    given = within_bound(names.select(F.explode("names").alias("name")), "name", most_bytes)
    if given is not None:
        return counted(rows, "text", given)
    found = contained_by_runs(names.select(F.explode("names").alias("passage")).distinct().select(F.col("passage").alias("item_id"), "passage"), rows.select(F.xxhash64("text").alias("doc_id"), "text").distinct())
    texts = rows.select(F.xxhash64("text").alias("_d"), "text").distinct()
    times = lambda: ((F.length("text") - F.length(F.replace("text", F.col("item_id"), F.lit("")))) / F.length("item_id")).cast("bigint")
    hits = found.join(texts, F.col("doc_id") == F.col("_d")).select("text", F.struct(F.col("item_id").alias("pattern"), times().alias("n")).alias("h")).where("h.n > 0").groupBy(F.col("text").alias("_t")).agg(F.array_sort(F.collect_list("h")).alias("hits"))
    return rows.join(hits, F.col("text") == F.col("_t"), "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<pattern:string,n:bigint>>"))).drop("text", "_t")


def chapter_scores(entries: DataFrame, histories: DataFrame, words=RELATION_WORDS, keys: list[str] | None = None, aliases: DataFrame | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(target, volume_id, chapter_index, score, reasons) of the chapters that a relation's history covers.

    entries: (keys, chapter_index, volume_id, text); histories: (keys, target, start, end); aliases: (target, aliases), the target alone where it has none. A chapter in the history scores 6, mentions of the target by any of its
    names with each keyword group more, two mentions 3, the relation's first and last chapter of a volume 2 each. Texts are scored before anything is joined: only counts go on.
    """
    keys = keys or []
    targets = histories.select("target").where("trim(target) <> ''").distinct()
    known = targets if aliases is None else targets.join(aliases, "target", "left")
    names = alias_sets(known if aliases is not None else known.withColumn("aliases", F.array().cast("array<string>")))
    found = with_hits(entries.select(*keys, "chapter_index", "volume_id", "text"), names, words, most_bytes)
    span = F.explode(F.sequence(F.least("start", "end"), F.greatest("start", "end")))
    rows = histories.select(*keys, "target", span.alias("chapter_index")).distinct().join(found, [*keys, "chapter_index"]).join(names, "target")
    mentions = F.aggregate(F.filter("hits", lambda h: F.array_contains("names", h["pattern"])), F.lit(0).cast("bigint"), lambda a, h: a + h["n"])
    rows = rows.withColumn("_m", mentions)
    signs = [(6, EVIDENCE, F.lit(True)), *((worth, reason, (F.col("_m") > 0) & F.get("groups", F.lit(i))) for i, (worth, _, reason) in enumerate(words)), (3, TWICE, F.col("_m") >= 2)]
    marks = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(worth).alias("worth"), F.lit(reason).alias("reason"))) for worth, reason, c in signs]))
    rows = rows.select(*keys, "target", "volume_id", "chapter_index", marks.alias("_marks"))
    volume = Window.partitionBy(*keys, "target", "volume_id")
    edge = lambda bound, reason: F.when(F.col("chapter_index") == bound("chapter_index").over(volume), F.struct(F.lit(2).alias("worth"), F.lit(reason).alias("reason")))
    rows = rows.withColumn("_marks", F.concat("_marks", F.array_compact(F.array(edge(F.min, STARTS), edge(F.max, ENDS)))))
    return rows.select(*keys, "target", "volume_id", "chapter_index", F.aggregate("_marks", F.lit(0), lambda a, m: a + m["worth"]).alias("score"), F.array_distinct(F.transform("_marks", lambda m: m["reason"])).alias("reasons"))


def critical_chapters(scored: DataFrame, keys: list[str] | None = None, strong: int = 10, fair: int = 6, most: int = 5) -> DataFrame:
    """Of each relation and volume the first and last chapter, all from `strong` points on and the best two from `fair` on; of these the best five."""
    volume = Window.partitionBy(*(keys or []), "target", "volume_id")
    return chosen_chapters(scored, volume, strong, fair, 2, most)


def with_context(chosen: DataFrame, chapters: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """`chosen` (keys, target, chapter_index, score, reasons) and the chapters on either side that there are (chapters: keys, chapter_index), with is_context: those score nothing and have CONTEXT as their reason."""
    keys = keys or []
    near = chosen.select(*keys, "target", F.explode(F.array(F.col("chapter_index") - 1, F.col("chapter_index") + 1)).alias("chapter_index")).distinct()
    there = near.join(chapters.select(*keys, "chapter_index").distinct(), [*keys, "chapter_index"], "left_semi")
    beside = there.join(chosen.select(*keys, "target", "chapter_index"), [*keys, "target", "chapter_index"], "left_anti")
    own = chosen.select(*keys, "target", "chapter_index", F.col("score").cast("bigint").alias("score"), "reasons", F.lit(False).alias("is_context"))
    return own.unionByName(beside.select(*keys, "target", "chapter_index", F.lit(0).cast("bigint").alias("score"), F.array(F.lit(CONTEXT)).alias("reasons"), F.lit(True).alias("is_context")))


def packets(rows: DataFrame, chapters: DataFrame, own_names: DataFrame, aliases: DataFrame, keys: list[str], chars: int = 1800) -> DataFrame:
    """`rows` (of with_context) with chapter_summary, volume_id and excerpt: the chapter's text around the names of both sides (own_names: keys, own; aliases: target, aliases; chapters: keys, chapter_index, volume_id,
    chapter_summary, content)."""
    names = alias_sets(rows.select("target").distinct().join(aliases, "target", "left"))
    words = F.array_distinct(F.concat(F.coalesce("own", F.array().cast("array<string>")), F.coalesce("names", F.array("target"))))
    met = rows.join(names, "target", "left").join(own_names, keys, "left")
    met = met.withColumn("_words", words).drop("names", "own").join(chapters, [*keys, "chapter_index"])
    return met.select(*rows.columns, "volume_id", "chapter_summary", excerpts(F.col("content"), F.col("_words"), chars).alias("excerpt"))
