"""The automaton against plain counting, and both ways of finding passages and names."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkloom.operators import evidence, patterns, relations


@settings(max_examples=200, deadline=None)
@given(st.text("ab中\0 ", max_size=60), st.lists(st.text("ab中\0 ", min_size=1, max_size=4), max_size=8))
def test_counts_are_those_of_plain_counting(text, names):
    got = patterns.counts(text, patterns.automaton_of(sorted(set(names))))
    assert got == {p: text.count(p) for p in set(names) if text.count(p)}


def test_both_ways_find_the_same(spark):
    draw = random.Random(4)
    words = ["ab", "abc", "b", "中文", "Ünder", "x.y", "a", "long word here now then"]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    texts = [(i, text(draw.randrange(0, 30))) for i in range(60)] + [(60, None), (61, "")]
    passages = [(i, text(draw.randrange(1, 9))) for i in range(40)] + [(40, ""), (41, None), (42, "b"), (43, "ab abc")]
    t, p = spark.createDataFrame(texts, "doc_id int, text string"), spark.createDataFrame(passages, "item_id int, passage string")
    want = sorted((i, d) for i, x in passages if x for d, y in texts if y and x in y)
    for most in (0, 1 << 20):
        assert sorted(map(tuple, evidence.contained(p, t, most_bytes=most).collect())) == want
    assert patterns.within_bound(p, "passage", 10) is None and len(patterns.within_bound(p, "passage")) == len({x for _, x in passages if x})


def test_relations_count_all_names_and_give_reasons(spark):
    entries = spark.createDataFrame([(1, 1, 1, "阿明救了小明"), (1, 2, 1, "没有人"), (1, 3, 1, None), (1, 4, 2, "明哥合作，明哥信任"), (1, 5, 2, ""), (2, 1, 1, "阿明")], "book_id int, chapter_index int, volume_id int, text string")
    histories = spark.createDataFrame([(1, "阿明", 1, 3), (1, "阿明", 4, 3), (1, "旁人", 2, 2), (1, "", 1, 1)], "book_id int, target string, start int, end int")
    aliases = spark.createDataFrame([("阿明", ["小明", " 明哥 ", "", "阿明", None]), ("没用", ["x"])], "target string, aliases array<string>")
    for most in (0, 1 << 20):
        got = {(r.target, r.chapter_index): (r.score, r.reasons) for r in relations.chapter_scores(entries, histories, keys=["book_id"], aliases=aliases, most_bytes=most).collect()}
        assert got == {
            ("阿明", 1): (17, [relations.EVIDENCE, "存在明确互动", relations.TWICE, relations.STARTS]), ("阿明", 2): (6, [relations.EVIDENCE]), ("阿明", 3): (8, [relations.EVIDENCE, relations.ENDS]),
            ("阿明", 4): (22, [relations.EVIDENCE, "关系变化信号", "情感指向明确", relations.TWICE, relations.STARTS, relations.ENDS]), ("旁人", 2): (10, [relations.EVIDENCE, relations.STARTS, relations.ENDS]),
        }
    chosen = relations.critical_chapters(relations.chapter_scores(entries, histories, keys=["book_id"], aliases=aliases), ["book_id"])
    near = relations.with_context(chosen.where("chapter_index <> 3"), entries, ["book_id"])
    got = {(r.target, r.chapter_index): (r.score, r.is_context) for r in near.collect()}
    assert got[("阿明", 5)] == (0, True) and got[("旁人", 1)] == (0, True) and got[("旁人", 3)] == (0, True) and got[("阿明", 3)] == (0, True) and got[("阿明", 1)] == (17, False)
    assert [r.reasons for r in near.where("is_context").select("reasons").distinct().collect()] == [[relations.CONTEXT]]
    summaries = entries.select("book_id", "chapter_index", "volume_id", F.lit("s").alias("chapter_summary"), F.col("text").alias("content"))
    packs = relations.packets(near, summaries, spark.createDataFrame([(1, ["合作"])], "book_id int, own array<string>"), aliases, ["book_id"], 9)
    assert {r.excerpt for r in packs.where("target = '阿明' AND chapter_index = 4").collect()} == {"明哥合作\n...\n"}


def test_slices_of_batches(spark, monkeypatch):
    from inkloom.operators import retrieval

    monkeypatch.setattr(patterns, "SLICE", 3)
    monkeypatch.setattr(retrieval, "MOST_DOCUMENTS", 3)
    rows = [(k, " ".join(f"w{(k * j) % 11}" for j in range(6))) for k in range(40)]
    docs = spark.createDataFrame(rows, "id bigint, text string").coalesce(1)
    got = {r.id: {h.pattern: h.n for h in r.hits} for r in patterns.counted(docs, "text", ["w1", "w3"]).collect()}
    assert got == {k: {p: t.count(p) for p in ("w1", "w3") if p in t} for k, t in rows}
    found = [(r.query_id, r.id, r.n) for r in retrieval.best_shared(docs, [1, 2], [["w1", "w3", "w5"], ["w10"]], "bigint", 5).collect()]
    shared = [(q, k, len(set(words) & set(t.split()))) for q, words in ((1, ["w1", "w3", "w5"]), (2, ["w10"])) for k, t in rows]
    expected = [x for q in (1, 2) for x in sorted((s for s in shared if s[0] == q and s[2]), key=lambda s: (-s[2], s[1]))[:5]]
    assert sorted(found) == sorted(expected)
