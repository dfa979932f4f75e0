"""Questions: intents by rules, parts, rewrites, domains, routes, budgets and the next step, as Column expressions over any number of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkloom.functions.text import question as ended
from inkloom.functions.text import trimmed

#: The words of each intent, in the order in which they are tried; questions about a name come first.
NAMING = "为什么.*叫|为何.*叫|为什么.*称为|为何.*称为|称号|名字来源|得名"
INTENTS = (
    ("existence_check", ("是否存在", "有没有", "有无", "是否出现")),
    ("first_appearance", ("第一次出场", "首次出场", "第一次出现", "首次出现", "初登场")),
    ("identity_ability", ("是谁", "身份", "什么能力", "能力", "背景")),
    ("causal_motivation", ("为什么", "动机", "原因", "为何", "怎么导致", "故意")),
    ("ending_fate", ("结局", "最后怎样", "最后怎么样", "下场", "最终如何", "后来怎么样")),
    ("quote_micro_detail", ("原话", "原文", "具体对白", "哪一句", "细节", "逐字")),
    ("timeline_evolution", ("完整剧情", "时间线", "发展", "演变", "全过程", "结局")),
)
#: Words that keywords leave out, that name a domain, that join two questions, that ask for everything, and that stand for a name.
STOPWORDS = ("的", "了", "吗", "呢", "和", "与", "中", "里", "请问", "小说")
ORGANISATION = ("组织", "势力", "阵营", "团队", "俱乐部", "国王组织")
WORLD_RULE = ("规则", "设定", "禁忌", "代价", "条件", "限制", "规律")
SPECIAL = ("厉鬼", "灵异", "鬼", "棺材钉", "八音盒", "特殊存在", "特殊物品")
CONNECTORS = ("以及", "并且", "同时", "还有", "而且", "并问")
EVERYTHING = ("完整信息", "完整介绍", "全面分析", "资料", "信息")
PRONOUNS = ("她", "他", "它", "其", "这个人", "这个角色", "这个组织")
NO_QUESTION = "请定位可回答该问题的章节级证据。"
#: By intent, what its queries add to the keywords, to the question for chapters and to the question for full texts, and the kind of its answer.
REWRITES = {
    "first_appearance": ("", "请确认首次出现章节和当时情境。", "请提取首次出场的直接原文依据。", "fact"),
    "causal_motivation": ("原因 动机 故意 导致", "请确认直接原因、动机链条和关键章节。", "请提取能直接支持原因或动机判断的原文依据。", "reasoning"),
    "ending_fate": ("结局 最后 下场 最终", "请确认最终状态、关键转折和章节依据。", "请提取能直接支持结局判断的原文依据。", "timeline"),
    "timeline_evolution": ("时间线 演变 过程 结局", "请按时间顺序确认关键节点与对应章节。", "请提取关键转折节点的原文依据。", "timeline"),
    "quote_micro_detail": ("", "请先定位最可能出现原话的章节。", "请提取可直接引用的原文或对白。", "quote"),
    "identity_ability": ("身份 能力 背景", "请确认身份定义、能力信息和章节依据。", "请提取可直接支持身份或能力判断的原文依据。", "reasoning"),
    "existence_check": ("", "请确认是否真实出现，并给出最早可定位章节。", "如存在，请提取最直接的原文依据。", "fact"),
}
#: The tools' names.
EDGE, SUMMARIES, CHAPTERS = "retrieve_entity_edge_records", "retrieve_chapter_summaries", "retrieve_chapters"
FIND = "hybrid_retrieve_"
FIND_SUMMARIES, PLOTS, VOLUMES = FIND + "chapter_summaries", FIND + "plots", FIND + "volumes"
#: Each intent's route; "*" is a step for each of the question's domains, "1" one for the first.
ROUTES = {
    "first_appearance": (EDGE, SUMMARIES, CHAPTERS),
    "identity_ability": ("*", PLOTS, FIND_SUMMARIES, SUMMARIES, CHAPTERS),
    "causal_motivation": (PLOTS, FIND_SUMMARIES, SUMMARIES, CHAPTERS),
    "ending_fate": (EDGE, SUMMARIES, CHAPTERS),
    "timeline_evolution": ("1", PLOTS, VOLUMES, SUMMARIES, CHAPTERS),
    "quote_micro_detail": (FIND_SUMMARIES, SUMMARIES, CHAPTERS),
    "existence_check": ("*", FIND_SUMMARIES, PLOTS, SUMMARIES),
    "general_fact": ("*", FIND_SUMMARIES, PLOTS, SUMMARIES, CHAPTERS),
}
#: Tool calls by intent and by the number of questions, the bounds of all budgets, and the intents that read much full text.
TOOL_CALLS = {"existence_check": 4, "first_appearance": 5, "identity_ability": 6, "ending_fate": 6, "general_fact": 6, "causal_motivation": 7, "timeline_evolution": 8, "quote_micro_detail": 8}
LEAST_CALLS = {1: 8, 2: 10, 3: 12}
MOST_CALLS, MOST_WINDOWS = 14, 3
MUCH_TEXT = ("timeline_evolution", "quote_micro_detail")
#: What names a part of an answer, in order; the last two go by intent.
LABELS = (("身份", "身份|是谁|背景|为什么叫|为何叫|称号"), ("结局", "结局|最后|下场"), ("首次出场", "第一次|首次"), ("原因", "为什么|原因|动机"), ("原文", "原话|原文|对白"))
INTENT_LABELS = {"timeline_evolution": "时间线", "existence_check": "存在性"}

WORD = "[\\u4e00-\\u9fffA-Za-z0-9_]"


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("|".join(words))


def _strings(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def intent(question: Column) -> Column:
    text = trimmed(question)
    out = F.lit("general_fact")
    for name, words in reversed(INTENTS):
        out = F.when(_has(text, words), name).otherwise(out)
    return F.when(text.rlike(NAMING), "identity_ability").otherwise(out)


def keywords(question: Column) -> Column:
    """The distinct runs of letters and digits that are no stop words, in order."""
    found = F.regexp_extract_all(F.coalesce(question, F.lit("")), F.lit(f"{WORD}+"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: ~x.isin(*STOPWORDS)))


def normalised(question: Column) -> Column:
    clean = ended(question)
    return F.when(clean == "", NO_QUESTION).otherwise(clean)


def anchor(question: Column) -> Column:
    """The name that a question is about: what stands before 的, else before a question word, else the first keyword."""
    text = trimmed(question)
    of = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.coalesce(of(f"({WORD}{{2,12}})的"), of(f"({WORD}{{2,12}})(?:是|是谁|有什么|如何|为什么)"), F.get(keywords(text), F.lit(0)), F.lit(""))


def explicit_parts(question: Column) -> Column:
    """The questions in a question, at question marks and joining words: distinct, of two characters at least, a pronoun at their beginning replaced by the name."""
    text, name = trimmed(question), anchor(question)
    pieces = F.split(F.regexp_replace(text, "|".join(CONNECTORS), "？"), "[？?；;。]+")
    of_name = lambda x: F.when((name != "") & x.rlike("^(?:" + "|".join(PRONOUNS) + ")"), F.concat(name, F.regexp_replace(x, "^(?:" + "|".join(PRONOUNS) + ")", ""))).otherwise(x)
    clean = F.transform(pieces, lambda x: F.regexp_replace(of_name(trimmed(x)), "^[，, ]+|[，, ]+$", ""))
    return F.transform(F.array_distinct(F.filter(clean, lambda x: F.length(x) >= 2)), normalised)


def parts(question: Column, most: int = 3) -> Column:
    """struct(source, parts): the questions that are asked: explicit ones, else two for a name of which everything is asked, else the question itself."""
    text, name, said = trimmed(question), anchor(question), explicit_parts(question)
    implied = F.array(F.concat(name, F.lit("的身份是什么？")), F.concat(name, F.lit("的关键经历和结局如何？")))
    everything = _has(text, EVERYTHING) & (name != "")
    source = F.when(F.size(said) >= 2, "explicit").when(everything, "implicit").otherwise("single")
    chosen = F.when(F.size(said) >= 2, said).when(everything, implied).when(F.size(said) == 1, said).otherwise(F.array(normalised(question)))
    return F.struct(source.alias("source"), F.slice(chosen, 1, most).alias("parts"))


def label(question: Column, kind: Column) -> Column:
    """What a part of the answer is called."""
    by_kind = reduce(lambda out, x: F.when(kind == x[0], x[1]).otherwise(out), INTENT_LABELS.items(), F.lit("问题"))
    return reduce(lambda out, x: F.when(trimmed(question).rlike(x[1]), x[0]).otherwise(out), reversed(LABELS), by_kind)


def rewrites(question: Column, kind: Column) -> Column:
    """struct(normalized_question, entity_query, plot_query, chapter_query, fulltext_query, answer_mode, entity_hints)."""
    whole, words = normalised(question), keywords(question)
    stack = F.when(F.size(words) > 0, F.array_join(F.slice(words, 1, 10), " ")).otherwise(F.regexp_replace(whole, "^[？?]+|[？?]+$", ""))
    bare = F.regexp_replace(whole, "[？?。]+$", "")
    by = lambda k, other: reduce(lambda out, x: F.when(kind == x[0], F.lit(x[1][k])).otherwise(out), REWRITES.items(), other)
    after = lambda k: F.when(kind.isin(*REWRITES), F.concat(bare, F.lit(" "), by(k, F.lit("")))).otherwise(whole)
    plot = F.when(by(0, F.lit("")) != "", F.concat(stack, F.lit(" "), by(0, F.lit("")))).otherwise(stack)
    return F.struct(whole.alias("normalized_question"), F.trim(stack).alias("entity_query"), F.trim(plot).alias("plot_query"), F.trim(after(1)).alias("chapter_query"), F.trim(after(2)).alias("fulltext_query"), by(3, F.lit("fact")).alias("answer_mode"), F.slice(words, 1, 4).alias("entity_hints"))


def entity_domains(question: Column, kind: Column) -> Column:
    """The domains that a question names; people come first for questions of who, where first and whether, unless it asks for rules."""
    one = lambda words, name: F.when(_has(question, words), _strings(name)).otherwise(_strings())
    named = F.concat(one(ORGANISATION, "origanizations"), one(WORLD_RULE, "world_rules"), one(SPECIAL, "special_existences"))
    people = kind.isin("identity_ability", "first_appearance", "existence_check") & ~F.array_contains(named, "world_rules")
    return F.when(people, F.concat(_strings("characters"), named)).otherwise(named)


def _tools(domains: Column) -> Column:
    return F.transform(domains, lambda d: F.concat(F.lit(FIND), d))


def route(kind: Column, domains: Column) -> Column:
    """The tools of a question's route, in order."""
    steps = lambda items: F.concat(*[_tools(domains) if x == "*" else F.slice(_tools(domains), 1, 1) if x == "1" else _strings(x) for x in items])
    return reduce(lambda out, x: F.when(kind == x[0], steps(x[1])).otherwise(out), ROUTES.items(), steps(ROUTES["general_fact"]))


def entry_tools(kind: Column, domains: Column) -> Column:
    """The tools that a question begins with."""
    first = F.slice(_tools(domains), 1, 1)
    named = F.size(domains) > 0
    with_people = F.concat(F.when(named, first).otherwise(_strings(FIND + "characters")), _strings(FIND_SUMMARIES))
    return (
        F.when(kind.isin("identity_ability", "existence_check"), with_people).when(kind.isin("first_appearance", "ending_fate"), _strings(EDGE)).when(kind == "causal_motivation", _strings(PLOTS, FIND_SUMMARIES))
        .when((kind == "timeline_evolution") & named, F.concat(first, _strings(PLOTS))).when(kind == "timeline_evolution", _strings(PLOTS, VOLUMES)).when(kind == "quote_micro_detail", _strings(FIND_SUMMARIES))
        .when(named, F.concat(first, _strings(FIND_SUMMARIES))).otherwise(_strings(FIND_SUMMARIES, PLOTS))
    )


def budget(kinds: Column, asked_calls: Column | None = None, asked_windows: Column | None = None) -> Column:
    """struct(tool_calls, fulltext_windows) for the intents of a question's parts, and what a plan asks for (8 and 2 by default)."""
    n = F.greatest(F.lit(1), F.size(kinds))
    each = F.aggregate(kinds, F.lit(0), lambda a, k: a + reduce(lambda out, x: F.when(k == x[0], x[1]).otherwise(out), TOOL_CALLS.items(), F.lit(TOOL_CALLS["general_fact"])))
    base = reduce(lambda out, x: F.when(n >= x[0], x[1]).otherwise(out), LEAST_CALLS.items(), F.lit(LEAST_CALLS[1]))
    wanted = F.greatest(base, F.least(F.lit(MOST_CALLS), each - F.least(F.lit(4), 2 * (n - 1)) + F.least(F.lit(3), n)))
    calls = F.greatest(wanted, F.greatest(F.lit(4), F.least(F.lit(MOST_CALLS), F.coalesce(asked_calls if asked_calls is not None else F.lit(8), F.lit(8)))))
    much = F.when(F.exists(kinds, lambda k: k.isin(*MUCH_TEXT)), 3).otherwise(2)
    windows = F.greatest(much, F.greatest(F.lit(1), F.least(F.lit(MOST_WINDOWS), F.coalesce(asked_windows if asked_windows is not None else F.lit(2), F.lit(2)))))
    return F.struct(F.least(F.lit(MOST_CALLS), calls).cast("int").alias("tool_calls"), F.least(F.lit(MOST_WINDOWS), windows).cast("int").alias("fulltext_windows"))


def fallbacks(state: Column) -> Column:
    """What goes wrong in a search's state (results, confidence, rerank_failed, embedding_failed, repeated, new_coordinates), the most urgent first."""
    rules = (
        ("embedding_api_unavailable", state["embedding_failed"]), ("loop_risk", state["repeated"]), ("hybrid_no_hit_or_low_confidence", (state["results"] == 0) | (state["confidence"] < 0.45)),
        ("no_new_coordinates", ~state["new_coordinates"]), ("rerank_unavailable", state["rerank_failed"]),
    )
    return F.array_compact(F.array(*[F.when(c, name) for name, c in rules]))


def next_step(steps: Column, state: Column) -> Column:
    """struct(next_tool, finalize): what follows in a search on its route, by its state (as above, with last_tool, calls and fulltext_calls)."""
    failed = fallbacks(state)
    answer = lambda tool, final=False: F.struct(tool.alias("next_tool"), F.lit(final).alias("finalize"))
    begin = F.coalesce(F.get(steps, F.lit(0)), F.lit(FIND_SUMMARIES))
    another = F.coalesce(F.get(F.filter(F.slice(steps, 2, 100), lambda x: x != state["last_tool"]), F.lit(0)), begin)
    done = answer(F.lit("finalize_answer"), True)
    return (
        F.when(state["repeated"], answer(F.lit("switch_level"))).when((state["calls"] >= 6) | (state["fulltext_calls"] >= 2), done).when(F.array_contains(failed, "embedding_api_unavailable"), answer(F.lit(SUMMARIES)))
        .when(F.array_contains(failed, "hybrid_no_hit_or_low_confidence"), answer(another)).when(F.array_contains(failed, "no_new_coordinates") & (state["calls"] >= 3), done).otherwise(answer(begin))
    )
