"""Hand-made cases of small functions: highlights, indexes of any shape, filters, logs, refined questions, layouts and colours."""

import json

from pyspark.sql import functions as F

from inkloom.functions import payloads, text
from inkloom.operators import answers, entities, facts, graph, search
from inkloom.operators.entries import merged_entries
from inkloom.sources import sinks


def one(spark, *columns):
    row = spark.range(1).select(*columns).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_highlights(spark):
    got = one(spark, *[text.highlighted(F.lit(e), F.lit(c)).alias(str(i)) for i, (e, c) in enumerate([(" a <b> a <b>\nz ", "<b>"), ("x", "y"), ("", "y"), ("x", " "), (None, None), ("a\nb", "a\nb")])])
    mark = f'<span style="{text.MARK}">'
    assert got == (f"a {mark}&lt;b&gt;</span> a &lt;b&gt;<br>z", f'<div style="{text.HEAD}">y</div><div>x</div>', "", "x", "", f"{mark}a<br>b</span>")


def test_indexes_of_any_shape(spark):
    payloads_ = [
        {"character_index": {"mentioned_characters": ["<甲>", "甲", 5, None, ""], "active_characters": "no list", "candidate_focus_characters": ["甲 - 乙"], "aliases_or_appellations": ["小甲", {"alias": " 阿甲 ", "name": "甲", "type": "nick"}, {"name": "甲"}, {"title": "老甲", "standard_name": "", "character_name": "甲"}, {"alias": "阿甲", "name": "甲", "type": "nick"}]}},
        {"entity_index": {"faction_index": {"active_factions": ["一派"], "faction_aliases_or_titles": [{"organization_alias": "派", "organization_name": "一派"}]}}, "character_index": []},
        [1, 2], "text",
    ]
    rows = [(i, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads_)] + [(9, "{broken"), (10, None)]
    got = {(r.k, r.entity_type, r.name_key): (r.name, tuple(r[f] for f in facts.FLAGS), r.source_aliases) for r in facts.index_mentions(spark.createDataFrame(rows, "k int, p string"), "k", "p").collect()}
    assert got == {
        (0, "character", "甲"): ("甲", (1, 0, 0, 1), ["阿甲", "老甲"]), (0, "character", "5"): ("5", (1, 0, 0, 0), []), (0, "character", "小甲"): ("小甲", (0, 0, 0, 0), ["小甲"]), (1, "faction", "一派"): ("一派", (0, 1, 0, 0), ["派"]),
    }


def test_ties_of_entries_take_no_place_twice(spark):
    names = ["甲", "乙", "丙", "甲（乙）", "丁", "乙", "戊（丁）"]
    rows = [(1, 1, 1, k, n, f"d{k}") for k, n in enumerate(names)]
    got = {r.place: (r.aliases, len(r.records)) for r in merged_entries(spark.createDataFrame(rows, "book_id bigint, plot_id bigint, chapter_index bigint, pos int, name string, description string")).collect()}
    assert got == {0: (["甲", "乙"], 3), 1: (["乙"], 1), 2: (["丙"], 1), 3: (["丁", "戊"], 2)}


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", "no"), (2, " ", None), (0, "c", None), (4, "d", "YES"), (5, "e", None), (None, "f", None)], "character_id int, name string, need_delete string")
    assert [r.character_id for r in entities.valid_characters(rows).orderBy("character_id").collect()] == [1, 5]
    records = spark.createDataFrame([(1, "x"), (1, "x"), (5, "x"), (5, "y")], "character_id int, record string")
    assert [r.character_id for r in entities.with_single_record(rows, records).collect()] == [1]
    hits = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4)], "query_id int, id int")
    kept = spark.createDataFrame([(1, 2), (9, 3)], "query_id int, id int")
    assert sorted(map(tuple, search.with_filter(hits, kept).collect())) == [(1, 2), (2, 3), (2, 4)]


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "who\n is it", "success", 0.9, " she ", ["Chapter 1", "Plot 2"]), ("r2", "what", None, None, "", [])], "request_id string, query string, status string, confidence double, answer string, citations array<string>")
    sinks.append_log(rows, str(tmp_path))
    assert sorted(r.request_id for r in spark.read.json(f"{tmp_path}/json").collect()) == ["r1", "r2"]
    pages = {r.value for r in spark.read.option("lineSep", "\n---\n").text(f"{tmp_path}/markdown").collect()}
    assert pages == {"# who is it\n\n- status: success\n- confidence: 0.9\n- citations: Chapter 1, Plot 2\n\n## Answer\n\nshe\n", "# what\n"}


def test_packets_keep_what_is_first(spark):
    rows = [(1, n, "chapters", n % 5 + 1, n if n % 2 else None, None, "s", "x" * 400, 0.5) for n in range(1, 21)]
    evidence = spark.createDataFrame(rows, "query_id int, rank int, source string, chapter_index int, plot_id int, volume_id int, source_name string, snippet string, score double")
    confirmed = spark.createDataFrame([(1, s, "L", n, "", "c", "e", 0.9, n) for s in (2, 1) for n in (1, 2, 3, 4)], "query_id int, subquery_id int, label string, chapter_index int, source_name string, claim string, excerpt string, confidence double, nth int")
    grounding = spark.createDataFrame([(1, None, None, list(range(12)), None, list("abcde"))], "query_id int, applied boolean, entity_type string, source_ids array<int>, reason string, selected array<string>")
    r = answers.packets(evidence, confirmed, grounding).first()
    assert [len(e.snippet) for e in r.evidence] == [320] * 4 and [e.chapter_index for e in r.evidence] == [2, 3, 4, 5]
    assert r.chapter_hits == [2, 3, 4, 5, 1, 2, 3, 4] and r.plot_hits == [1, 3, 5, 7, 9, 11, 13, 15] and r.volume_hits == []
    assert [(c.subquery_id, c.chapter_index) for c in r.confirmed] == [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1), (2, 2)]
    assert tuple(r.grounding) == (False, "", list(range(8)), "", ["a", "b", "c"])


def test_refined_questions(spark):
    r = one(spark, answers.refined(F.lit("古城的钥匙在哪？"), F.lit("古城钥匙"), F.array(F.lit("古城城主"), F.lit("别人"), F.lit(None)), F.array(F.lit("古城钥匙孔，未提及任何"), F.lit("城门"), F.lit("钥匙环"))))
    assert r.entity_query.split(" ")[0] == "古城钥匙" and "古城城主" in r.entity_query and "别人" not in r.plot_query
    assert r.chapter_query.startswith("古城的钥匙在哪 请重点核验以下线索：") and r.chapter_query.endswith("。")


def test_layouts_colours_and_summaries(spark):
    nodes = spark.createDataFrame([(1, 0.0, 5.0), (2, 10.0, 5.0), (3, 5.0, 5.0)], "node_id int, x double, y double")
    assert [(r.cx, r.cy) for r in graph.canvas(nodes, 100.0).orderBy("node_id").collect()] == [(0.0, 50.0), (100.0, 50.0), (50.0, 50.0)]
    assert one(spark, graph.node_color(F.lit("ready")), graph.node_color(F.lit("stub")).alias("b"), graph.node_color(F.lit(None)).alias("c")) == (graph.READY, graph.STUB, graph.STUB)
    raw = json.dumps({"target_character": " 甲 ", "relation_summary": "好", "intensity": "HIGH", "secondary_emotional_tendencies": ["a", "a"], "timeline": [{"chapter_start": 9, "chapter_end": 3, "summary": "b"}, {"chapter_start": 2, "summary": "a"}, {"chapter_start": 0, "summary": "x"}, {"chapter_start": 4, "summary": " "}]}, ensure_ascii=False)
    r = one(spark, payloads.relation_summary(F.lit(raw)))
    assert (r.target_character, r.relation_summary, r.intensity, r.current_status) == ("甲", "好", "high", "")
    assert [tuple(t) for t in r.timeline] == [(2, 2, "a"), (9, 9, "b")]


def test_indexes_are_gone_through_once(spark):
    """Names, lists and other names of an index come of one pass over it."""
    found = facts.index_mentions(spark.createDataFrame([(1, "{}")], "k int, p string"), "k", "p")
    assert found._jdf.queryExecution().executedPlan().toString().count("Generate posexplode") == 1
