"""Rules on hand-made cases: names, candidates, grounding, payloads, planning, states; nulls, ties and empty tables."""

from pyspark.sql import functions as F

from inkloom.functions import names, payloads, text
from inkloom.operators import answers, candidates, evidence, facts, grounding, hierarchy, planner, ranks, states
from inkloom.sources import tables


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_names(spark):
    cases = {"张三的妈妈": (True, False, 1), "妈妈": (False, True, 0), "那个老人": (False, True, 0), "小明": (False, False, 3), "张三": (False, False, 0), "王秘书": (False, False, 2), "的妈妈": (False, False, 0), " ": (False, True, 2), None: (False, True, 2)}
    df = spark.createDataFrame([(n,) for n in cases], "n string")
    c = F.col("n")
    got = {r.n: (r.a, r.g, r.r) for r in df.select("n", names.anchored(c).alias("a"), names.generic(c).alias("g"), names.name_rank(F.coalesce(c, F.lit("")))["rank"].alias("r")).collect()}
    assert got == cases
    entry = lambda n, al: names.normal_entry("characters", F.lit(n), F.array(*map(F.lit, al)) if al is not None else F.lit(None).cast("array<string>"))
    r = one(spark, a=entry("小明/李明", ["那个李明", "老师", " 李明"]), b=entry("老师", ["学生"]), c=entry("张三的妈妈", None))
    assert (r.a.name, r.a.aliases) == ("李明", ["李明", "小明"]) and r.b is None and r.c.name == "张三的妈妈"
    assert one(spark, r=names.root(F.lit("张副所长"), names.TITLES), s=names.root(F.lit("王 先生"))) == ("张", "王")


def test_candidate_groups(spark):
    rows = [(1, "阿甲", [], [("3", "他改名为阿乙，走了")]), (2, "阿乙", None, []), (3, "梅洛", [], []), (4, "梅洛公主", [], [("1", None)]), (5, "别人", [], [("2", "就是‘阿甲’")])]
    items = spark.createDataFrame(rows, "item_id int, name string, aliases array<string>, records array<struct<chapter:string,text:string>>")
    groups = {}
    for r in candidates.groups(items).collect():
        groups.setdefault(r.group_id, set()).add(r.item_id)
    assert groups == {1: {1, 2}, 3: {3, 4}}
    assert candidates.groups(items.limit(0)).count() == 0
    records = spark.createDataFrame([(1, c, t) for c, t in [("10", "a"), ("2", "b"), ("100", "c"), ("36", "d"), ("x", "e"), ("2", "b"), ("2", "a")]], "k int, chapter string, text string")
    assert [(r.chapter, r.text) for r in candidates.merged_records(records, "k").orderBy("nth").collect()] == [("2", "a"), ("2", "b"), ("10", "a"), ("36", "d"), ("100", "c"), ("x", "e")]
    many = spark.createDataFrame([(1, i) for i in range(1, 300)] + [(2, 5), (2, 5), (2, 0)], "k int, chapter_index int")
    got = {}
    for r in candidates.sampled_chapters(many, "k").collect():
        got.setdefault(r.k, set()).add(r.chapter_index)
    assert len(got[1]) == 100 and set(range(1, 21)) | set(range(280, 300)) <= got[1] and got[2] == {5}


def test_grounding(spark):
    questions = spark.createDataFrame([(1, 0, "who is Ann Lee?"), (2, 0, "annlee and bob"), (3, 0, "the fox"), (4, 0, None), (5, 0, "Bob or Ann Lee")], "query_id int, place int, text string")
    entities = spark.createDataFrame([("characters", 1, "<Ann Lee>", ["the fox"]), ("characters", 2, "Bob", None), ("world_rules", 9, "", ["x"])], "entity_type string, source_id int, name string, aliases array<string>")
    found = grounding.matches(questions, entities)
    assert {(r.query_id, r.source_id, r.mode, r.confidence) for r in found.collect()} == {(1, 1, "exact_name", 1.0), (2, 1, "substring_alias", 0.86), (2, 2, "substring_alias", 0.86), (3, 1, "exact_alias", 0.97), (5, 1, "exact_name", 1.0), (5, 2, "exact_name", 1.0)}
    got = {r.query_id: (r.applied, r.reason, r.source_ids) for r in grounding.decisions(questions, found).collect()}
    assert got == {1: (True, "high_confidence_alias_grounding", [1]), 2: (False, "no_high_confidence_grounding", []), 3: (True, "high_confidence_alias_grounding", [1]), 4: (False, "no_grounding_match", []), 5: (False, "ambiguous_grounding", [])}


def test_payloads(spark):
    raw = '{"chapter_summary": "s", "character": [{"name": "a", "description": "d"}], "special_existence": [], "world_rules": [], "organizations": [], "ambiguous_character_mentions": [{"name": "x", "note": "y"}]}'
    cases = {raw: "ambiguous_character_mentions[0] missing evidence_excerpt", raw.replace(', "note": "y"', ', "note": "y", "quote": "q"'): None, "{}": "missing chapter_summary", "": "payload is not a JSON object", None: "payload is not a JSON object", '{"chapter_summary": "s", "characters": ["a"]}': "character[0] is not an object"}
    df = spark.createDataFrame([(c,) for c in cases], "r string")
    assert {r.r: r.f for r in df.select("r", payloads.payload_fault(F.col("r")).alias("f")).collect()} == cases
    p = one(spark, p=payloads.profile(F.lit('{"appearance": ["tall", " tall", ""], "volume_arc": [{"volume_index": "2"}, 5], "critical_evidence": [{"chapter_index": 0}, {"chapter_index": 3, "reasons": ["r"]}]}'), F.lit(1).cast("bigint"), F.lit(9).cast("bigint"), F.array(F.lit("n")))).p
    assert p.appearance == ["tall"] and p.volume_arc[0].volume_title == "第2卷" and [e.chapter_index for e in p.critical_evidence] == [3] and (p.identity.first_chapter_index, p.identity.aliases, p.style_samples) == (1, ["n"], [])
    r = one(spark, a=payloads.chapter_result(F.lit(None).cast("string"), F.lit(True)), b=payloads.style_batch(F.lit("no json")), c=payloads.described(F.lit('{"k": "v", "n": null}')))
    assert (r.a.status, r.a.needs_fulltext) == ("MISS", False) and r.b.style_samples == [] and [(x.name, x.description) for x in r.c] == [("k", "v"), ("n", "")]


def test_planning_and_answers(spark):
    q = F.lit(None).cast("string")
    r = one(spark, i=planner.intent(q), p=planner.parts(q), d=planner.entity_domains(q, F.lit("x")), e=planner.entry_tools(F.lit("timeline_evolution"), F.array().cast("array<string>")), b=planner.budget(F.array().cast("array<string>")))
    assert (r.i, r.p.parts, r.d, r.e, tuple(r.b)) == ("general_fact", [planner.NO_QUESTION], [], [planner.PLOTS, planner.VOLUMES], (8, 2))
    refined = one(spark, r=answers.refined(F.lit("阿甲的身份？"), F.lit("阿甲 身份"), F.array(F.lit("阿甲乙"), F.lit("别人")), F.array(F.lit("阿甲来了，天晴"), F.lit(None).cast("string")))).r
    assert refined.terms == ["阿甲", "身份", "阿甲乙", "阿甲来了"] and refined.chapter_query == "阿甲的身份 请重点核验以下线索：阿甲、身份、阿甲乙、阿甲来了。"
    assert [x.n for x in spark.createDataFrame([(None,), (" ",), ("未提及",), ("yes",)], "t string").select(evidence.negative(F.col("t")).alias("n")).collect()] == [True, True, True, False]
    skip = one(spark, a=answers.skips_summaries(F.lit("ending_fate"), F.lit(3), F.lit(5)), b=answers.skips_summaries(F.lit("ending_fate"), F.lit(None).cast("int"), F.lit(5)), c=answers.recovery(F.lit(False), F.lit(1), F.lit(0.9), F.lit(True), F.lit(1), F.lit(0))["reason"])
    assert tuple(skip) == (True, False, "conflicting_evidence")


def test_states_and_ranges(spark):
    times = {"2024-01-02 03:04:05": "2024-01-02 03:04:05", "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05+08:00": "2024-01-02 03:04:05", "2024-01-02": "2024-01-02 00:00:00", "2.1.2024": None, "": None, None: None}
    df = spark.createDataFrame([(t,) for t in times], "t string")
    assert {r.t: r.x and str(r.x) for r in df.select("t", states.parsed_time(F.col("t")).alias("x")).collect()} == times
    head = spark.createDataFrame([("\n第3章\n风\n正文",), ("第3章 风\n正文",), ("正文",), (None,)], "t string").select(text.heading(F.col("t")).alias("h"), text.without_heading(F.col("t"), F.lit("第3章 风")).alias("r")).collect()
    assert [(r.h, r.r) for r in head] == [("第3章", "正文"), ("第3章 风", "正文"), (None, "正文"), (None, "")]
    batches = spark.createDataFrame([(1, 0, 1, 10), (1, 1, 11, 20)], "book_id int, batch_no int, low int, high int")
    ranges = spark.createDataFrame([(1, 0, 0, 4), (1, 0, 5, 99), (1, 1, 30, 2)], "book_id int, batch_no int, start int, end int")
    assert {tuple(r) for r in hierarchy.clamped(ranges, batches).collect()} == {(1, 0, 1, 4), (1, 0, 5, 10), (1, 1, 11, 20)}
    names_ = one(spark, a=facts.canonical(F.lit(" 《x》 - y")), b=facts.canonical(F.lit("<a - b>")), c=facts.canonical(F.lit(None).cast("string")), d=facts.entity_key(F.lit("《A b》")))
    assert tuple(names_) == ("《x》", "a", "", "ab")
    whole = ranks.numbered_whole(spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 1)], "s string, i int"), [F.col("s"), F.col("i")], "n")
    assert [(r.s, r.i) for r in whole.orderBy("n").collect()] == [(None, 3), ("a", 1), ("a", 2), ("b", 1)] and ranks.numbered_whole(whole.limit(0).drop("n"), [F.col("s")], "n").count() == 0


def test_chapters_of_any_sources(spark, tmp_path):
    rows = [(3, "web", "One. Two, longer one. X"), (1, None, None), (2, "web", ""), (4, "Blog", "y")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.book_id, r.chapter_index): (r.doc_id, r.chapter_summary, r.word_count) for r in tables.chapters(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (4, "y", 1), (2, 1): (2, "", 0), (2, 2): (3, "One. Two, longer one. X", 19), (3, 1): (1, "", 0)}
