"""Operators on small hand-made tables: ties, nulls, empty tables, hot keys, streams, sinks."""

import json
import random

import pandas as pd
from pyspark.sql import functions as F

from inkloom.operators import dataset, entities, evidence, graph, hierarchy, profiles, ranks, relations, retrieval, sessions, sync
from inkloom.operators.components import components
from inkloom.streaming import sessions as streams


def test_numbered(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else f"k{rng.randrange(4)}", rng.randrange(-9000, 9000) * 10 + i % 10) for i in range(2000)] + [(None, 5), ("hot", None)]
    rows = list(dict.fromkeys(rows))
    got = ranks.numbered(spark.createDataFrame(rows, "k string, o bigint"), "k", "o", "n", width=100).collect()
    for key in {k for k, _ in rows}:
        mine = sorted((r for r in got if r.k == key), key=lambda r: r.n)
        assert [r.n for r in mine] == list(range(1, len(mine) + 1))
        assert [r.o for r in mine] == sorted((o for k, o in rows if k == key), key=lambda o: (o is not None, o or 0))


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 90), (5, 5), (None, 3)]
    assert {r.v: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == {k: 1 for k in range(1, 41)} | {100: 90, 90: 90}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def islands_by_hand(events):
    out = []
    for e in sorted(events):
        start, end, *kind, summary = e
        if out and out[-1][2:5] == kind and start <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, *kind])
    return [tuple(x) for x in out]


def test_islands(spark):
    rng = random.Random(3)
    events = [(a := rng.randrange(30), a + rng.randrange(5), rng.choice("ab"), rng.choice("pq"), "s", f"e{i}") for i in range(60)]
    events += [(1, 2, "a", "p", "s", "x"), (3, 3, "a", "p", "s", "y"), (1, 2, "a", "p", "s", "x")]
    df = spark.createDataFrame([(1, *e) for e in events], "k int, chapter_start int, chapter_end int, relation_type string, polarity string, strength string, summary string")
    got = relations.islands(df, ["k"]).orderBy("island").collect()
    assert [(r.chapter_start, r.chapter_end, r.relation_type, r.polarity, r.strength) for r in got] == islands_by_hand(events)
    assert relations.islands(df.limit(0), ["k"]).count() == 0


def test_stitching(spark):
    joins = [True, True, False, True, False, True, True, True, False]
    rows = [(1, i, j) for i, j in enumerate(joins)]
    got = [r.group for r in hierarchy.stitched(spark.createDataFrame(rows, "b int, o int, j boolean"), "b", "o", "j").orderBy("o").collect()]
    expected, i, group = [], 0, 0
    while i < len(joins):
        group += 1
        take = 2 if joins[i] and i + 1 < len(joins) else 1
        expected += [group] * take
        i += take
    assert got == expected


def test_packing(spark):
    rng = random.Random(7)
    rows = [(1, v, c, rng.randrange(0, 3000) if c % 9 else 9000) for v in range(3) for c in range(v * 50, v * 50 + 40)]
    got = profiles.packed_windows(spark.createDataFrame(rows, "character_id bigint, volume_id bigint, chapter_index bigint, chars bigint")).collect()
    for v in range(3):
        mine = sorted((r for r in got if r.volume_id == v), key=lambda r: r.window_no)
        assert sum(r.chapters for r in mine) == 40 and all(r.chapters == 1 or r.chars <= 4000 for r in mine) and all(r.chapters <= 18 for r in mine)


def test_grounding(spark):
    texts = [(1, "the quick brown fox jumps over it"), (2, "aquick brown fox jumps over itb"), (3, None), (4, "fox")]
    passages = [(1, "quick brown fox jumps over it"), (2, "fox"), (3, "no such words in any text here"), (4, None)]
    got = evidence.contained(spark.createDataFrame(passages, "item_id int, passage string"), spark.createDataFrame(texts, "doc_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, d) for i, p in passages for d, t in texts if p and t and p in t}


def test_grounding_of_many_short_passages(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 12))) for _ in range(40)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(50)] + [(90, ""), (91, None), (92, "a")]
    whole = " ".join(t for _, t in texts if t)
    passages = [(i, whole[a : a + rng.randrange(1, 14)]) for i, a in enumerate(rng.randrange(len(whole)) for _ in range(1500))] + [(9000, ""), (9001, "zzz"), (9002, "a long passage of words that no text has")]
    got = evidence.contained(spark.createDataFrame(passages, "item_id int, passage string"), spark.createDataFrame(texts, "doc_id int, text string"))
    assert {tuple(r) for r in got.collect()} == {(i, d) for i, p in passages for d, t in texts if p and t and p in t}


def test_stitching_rounds(spark):
    rng = random.Random(2)
    rows = [(b, i, i, [rng.choice("xyz")], [rng.choice("xyz")]) for b in range(4) for i in range(1, 40 - 9 * b)]
    df = spark.createDataFrame(rows, "book_id bigint, start bigint, end bigint, head array<string>, tail array<string>")

    def greedy(now, disjoint):
        out, i = [], 0
        while i < len(now):
            if i + 1 < len(now) and set(now[i][3]) & set(now[i + 1][2]):
                out.append((now[i][0], now[i + 1][1], now[i][2], now[i + 1][3]))
                i += 2
            else:
                out.append(now[i])
                i += 1
                if disjoint and i < len(now):
                    out.append(now[i])
                    i += 1
        return out

    for disjoint, most in ((False, 5), (True, 8)):
        expected = set()
        for b in range(4):
            now = [(s, e, h, t) for x, s, e, h, t in rows if x == b]
            for _ in range(most):
                now = greedy(now, disjoint)
            expected |= {(b, s, e) for s, e, _, _ in now}
        assert {tuple(r) for r in hierarchy.stitched_rounds(df, most, disjoint).collect()} == expected


def test_excerpts(spark):
    rng = random.Random(6)
    rows = [("".join(rng.choice("abc ") for _ in range(rng.randrange(0, 200))), [rng.choice(["ab", "c a", "zz", " ", "b", ""]) for _ in range(rng.randrange(0, 5))]) for _ in range(80)] + [(None, ["a"]), ("x" * 500, ["x", "x"])]

    def by_hand(text, words, most):
        text = (text or "").strip(" ")
        spans = sorted((max(0, at - most // 3), min(len(text), at + most // 2)) for w in words if w.strip(" ") and (at := text.find(w.strip(" "))) >= 0)
        parts, used = [], 0
        for a, z in spans:
            piece = text[a:z].strip(" ")
            if piece and used < most:
                parts.append(piece[: most - used])
                used += len(parts[-1])
        return "\n...\n".join(parts).strip(" ")[:most] if spans else text[:most]

    df = spark.createDataFrame(rows, "t string, w array<string>")
    assert [r.x for r in df.select(profiles.excerpts(F.col("t"), F.col("w"), 60).alias("x")).collect()] == [by_hand(t, w, 60) for t, w in rows]


def test_evidence_scores(spark):
    rows = [("chapters", 2, 0.5), ("plots", 3, -1.0), ("other", None, None)]
    df = spark.createDataFrame(rows, "source string, rank int, score double")
    got = [round(r.s, 6) for r in df.select(evidence.evidence_score(F.col("source"), F.col("rank"), F.col("score")).alias("s")).collect()]
    assert got == [0.5, round(0.72 / 3, 6), round(0.65 / 5, 6)]


def test_retrieval(spark):
    hits = spark.createDataFrame([(1, i, 1.0 - i / 10, i + 1) for i in range(5)], "query_id int, id int, score double, rank int")
    few = spark.createDataFrame([(1, 4, 0.9, 1), (1, 9, 0.5, 2)], "query_id int, id int, sparse_score double, sparse_rank int")
    fused = retrieval.fused(hits, few, 10)
    assert [r.id for r in fused.orderBy("fused_rank").collect()] == [4, 0, 1, 9, 2, 3]
    scores = spark.createDataFrame([(1, 3, 0.9), (1, 77, 1.0)], "query_id int, id int, rerank_score double")
    assert [r.id for r in retrieval.reranked(fused, scores, 3).orderBy("final_rank").collect()] == [3, 4, 0]


def test_sync(spark, tmp_path):
    new = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, h string")
    old = spark.createDataFrame([(2, "x"), (3, "c"), (None, "n")], "k int, h string")
    assert {(r.k, r.action) for r in sync.actions(new, old, ["k"], "h").collect()} == {(1, "insert"), (2, "update"), (3, "delete"), (None, "skip")}
    path = str(tmp_path / "t")
    sync.rewrite_partitions(spark.createDataFrame([(1, "a"), (2, "b")], "book_id int, x string"), path, ["book_id"])
    sync.rewrite_partitions(spark.createDataFrame([(2, "c")], "book_id int, x string"), path, ["book_id"])
    assert {(r.book_id, r.x) for r in spark.read.parquet(path).collect()} == {(1, "a"), (2, "c")}


def test_export(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1, "1:1", "p", "c"), ("validation", 2, "2:1", "q", "d")], "split string, book_id int, sample_id string, prompt string, content string")
    dataset.export(rows, str(tmp_path))
    line = next(p for p in (tmp_path / "messages/split=train").iterdir() if p.suffix == ".json").read_text().splitlines()[0]
    assert [m["role"] for m in json.loads(line)["messages"]] == ["system", "user", "assistant"]
    split = {r.book_id: r.split for r in dataset.book_split(spark.createDataFrame([(i,) for i in range(1, 5)], "book_id int")).collect()}
    assert sorted(split.values()) == ["train"] * 3 + ["validation"]


def test_entities_and_graph(spark):
    items = spark.createDataFrame([(1, "A", ["x", "y"]), (2, "B", ["z"]), (3, "C", ["y", "z"]), (4, "D", [])], "item_id int, name string, aliases array<string>")
    member = entities.alias_components(items)
    assert {r.item_id: r.component for r in member.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    got = {r.component: (r.name, r.aliases) for r in entities.merged(items, member).collect()}
    assert got == {1: ("A", ["x", "y", "z"]), 4: ("D", None)}
    edges = spark.createDataFrame([(1, 1), (1, 2)], "source_id int, target_id int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "node_id int")
    assert {r.node_id: (r.degree, r.size) for r in graph.degrees(nodes, edges).collect()} == {1: (3, 27), 2: (1, 21), 3: (0, 18)}


def test_pages(spark):
    rows = spark.range(25)
    assert [r.id for r in sessions.page(rows, [F.asc("id")], 9).collect()] == list(range(20, 25))
    assert sessions.page(rows.limit(0), [F.asc("id")], 1).count() == 0


def test_streams(spark, small, tmp_path):
    events = streams.read(spark, small)
    streams.run_once(streams.sessions(events), str(tmp_path / "out"), str(tmp_path / "state"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert rows and all(r.ended > r.started and r.n >= 1 for r in rows)


def test_summaries_of_users_with_many_events(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ids = list(range(30_000))
    random.Random(3).shuffle(ids)
    pd.DataFrame({"event_id": ids, "ts": pd.Timestamp("2024-01-01"), "user_id": [i % 2 for i in ids], "event_type": "view", "value": 1.0, "props": "{}"}).to_parquet(tmp_path / "in" / "events.parquet", coerce_timestamps="us")
    streams.run_once(streams.due(streams.read(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.user_id, r.upto, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == sorted((u, own[k], 11) for u in (0, 1) for own in [sorted(i for i in ids if i % 2 == u)] for k in range(10, len(own), 11))


def test_hybrid_search(spark):
    from inkloom.operators import search

    chapters = spark.createDataFrame([(i, 1 + i % 2, i // 2 + 1, t) for i, t in enumerate(["red fox runs", "x", "blue fox", "y", "red fox red fox", "z", "nothing here", "red"])], "id bigint, book_id bigint, chapter_index bigint, text string")
    asked = spark.createDataFrame([(7, 1, "red fox"), (8, 2, "red"), (9, 3, "none")], "query_id bigint, book_id bigint, query string")
    rows = search.hybrid(asked, chapters, "volumes").orderBy("query_id", "final_rank").collect()
    assert [(r.query_id, r.id) for r in rows if r.query_id == 7][:2] in ([(7, 4), (7, 0)], [(7, 0), (7, 4)]) and not [r for r in rows if r.query_id == 9]
    assert rows[-1].query_id == 8 and {r.id for r in rows if r.query_id == 8} <= {1, 3, 5, 7}
    assert next(r for r in rows if r.query_id == 8).id == 7
    found = {r.query_id: r for r in search.research(asked, chapters).collect()}
    assert found[7].best_chapter in (1, 3) and found[7].citations.startswith("Chapter ") and 0.9 <= found[7].confidence <= 0.95


def test_filter_rule(spark):
    from inkloom.operators import search

    rows = [("what", 0, "", None, None, None), ("what", 1, "", 1.0, None, None), ("为什么", 5, "", 1.0, 0.9, 0.8), ("red fox", 2, "a red fox", 1.0, 0.5, None), ("red fox", 6, "a red fox", 1.0, 0.8, 0.7), ("red fox", 9, "no", 1.0, 0.99, 0.98), ("red fox", 5, "no", 1.0, 0.99, 0.98)]
    df = spark.createDataFrame(rows, "q string, n int, t string, a double, b double, c double")
    got = [r.r.reason for r in df.select(search.wants_filter(*map(F.col, "qntabc")).alias("r")).collect()]
    assert got == ["empty_candidates", "heuristic_skip_single_candidate", "auto_complex_query", "heuristic_skip_precise_small_set", "heuristic_skip_high_confidence_gap", "auto_large_candidate_set", "auto_ambiguous_candidates"]


def test_entries(spark):
    from inkloom.operators.entries import merged_entries

    rows = [(1, 1, 1, 0, "Anna（A/Ann）", "d1"), (1, 1, 1, 1, "Bob", "b"), (1, 1, 2, 0, "ann", "d2"), (1, 1, 2, 1, "Cid（bob、C）", "c"), (1, 1, 2, 2, "ann", "d2"), (1, 2, 6, 0, "Bob", None), (1, 2, 6, 1, " ", "x")]
    got = {(r.plot_id, r.place): (r.name, [(x.chapter, x.text) for x in r.records]) for r in merged_entries(spark.createDataFrame(rows, "book_id bigint, plot_id bigint, chapter_index bigint, pos int, name string, description string")).collect()}
    assert got == {(1, 0): ("Anna（A/Ann）", [(1, "d1"), (2, "d2")]), (1, 1): ("Bob（Cid/C）", [(1, "b"), (2, "c")]), (2, 0): ("Bob", [(6, "")])}


def test_aliases(spark):
    from inkloom.functions.aliases import display_name, flattened, stored_aliases

    cases = {"“甲”、乙（丙/丁）": ["甲", "丁", "乙", "丙"], "甲（乙": ["甲", "乙"], "": [], None: [], "a.": ["a."], "[甲]": ["甲"], "J.R.": ["J.R."], "a（b）（c）": ["c", "a", "b"], "a(b(c(d": ["a", "b", "c", "d"], "'`x`'": ["x"], "）": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", flattened(F.col("t")).alias("x")).collect()
    assert {r.t: r.x for r in rows} == cases
    df = spark.createDataFrame([("甲", ["乙/甲", "丙（丁）"]), ("甲", None)], "n string, a array<string>")
    assert [r.x for r in df.select(stored_aliases(F.col("n"), F.col("a")).alias("x")).collect()] == [["甲", "乙", "丙", "丁"], ["甲"]]
    assert df.select(display_name(F.col("n"), F.array(F.lit("甲"), F.lit("x"))).alias("x")).first().x == "甲（x）"


def test_normalised_events(spark):
    windows = spark.createDataFrame([(1, 10, 20)], "window_id int, low int, high int")
    rows = [(1, "A", "B", 5, 30, None, "", "high", " s ", [3, 12, 12, 40]), (1, "A", " a", 11, 12, "t", "p", "s", "x", [11]), (1, "A", "C", None, None, "t", "p", None, None, []), (1, "A", "", 11, 12, "t", "p", "s", "x", None), (1, "A", "D", 18, 12, "t", "p", "s", "x", [18])]
    df = spark.createDataFrame(rows, "window_id int, source string, target string, start int, end int, relation_type string, polarity string, strength string, summary string, evidence array<int>")
    got = {r.target: (r.start, r.end, r.polarity, r.strength, r.summary, r.evidence) for r in relations.normalised(df, windows).collect()}
    assert got == {"B": (10, 20, "neutral", "high", "s", [12]), "C": (10, 10, "p", "medium", "", [10]), "D": (18, 18, "p", "s", "x", [18])}


def test_sinks_and_models(spark, tmp_path):
    from inkloom import models
    from inkloom.sources import sinks

    path = str(tmp_path / "c")
    sinks.save_chapters(spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "book_id int, x string"), path)
    lost = sinks.delete_book(spark, {"chapters": path}, 2, str(tmp_path / "out"))
    assert [tuple(r) for r in lost.collect()] == [("chapters", 2)] and spark.read.parquet(str(tmp_path / "out/chapters")).count() == 1
    sinks.append_messages(spark.createDataFrame([(1, "robot", -5)], "session_id int, role string, token_count int"), str(tmp_path / "m"))
    assert tuple(spark.read.parquet(str(tmp_path / "m")).first())[1:] == ("user", 0)
    one = spark.createDataFrame([("One two. Three four",)], "t string")
    assert one.select(models.first_sentences(15)(F.col("t")).alias("x")).first().x == "One two."
    assert sum(one.select(models.hashed_embedding(8)(F.col("t")).alias("x")).first().x) == 4


def test_ranges_meet_the_rows_of_their_cell(spark):
    """A row takes the first range that holds it, over cells' borders too, and a book's rows don't meet all its ranges."""
    from inkloom.operators import hierarchy

    rows = spark.range(1, 200).selectExpr("id % 2 + 1 AS book_id", "id AS chapter_index")
    given = [(1, 4, 60, 70), (1, 2, 64, 64), (1, 9, 1, 199), (2, 3, 5, 3), (2, 5, 120, 130), (3, 1, 1, 9)]
    ranges = spark.createDataFrame(given, "book_id bigint, volume_id bigint, start_chapter bigint, end_chapter bigint")
    found = hierarchy.containing_range(rows, ranges)
    expected = {(b, c, min((v for k, v, a, z in given if k == b and a <= c <= z), default=0)) for b, c in ((i % 2 + 1, i) for i in range(1, 200))}
    assert {tuple(r) for r in found.select("book_id", "chapter_index", "volume_id").collect()} == expected
    assert "_cell" in found._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_found_as_by_the_plain_pattern(spark):
    import re

    from pyspark.sql import functions as F

    from inkloom.models import SENTENCE

    texts = ["", "...", "a. b!? c", "。！一二。三？！ é\u00ff\u0100. x", "\U0001f600a.\U00020000。\uffff!", "\n\t. \x7f\x80", "w " * 500_000 + ".", "字" * 500_000]
    got = [r.x for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(F.regexp_extract_all("t", F.lit(SENTENCE), F.lit(0)).alias("x")).collect()]
    assert got == [re.findall("[^.!?。！？]+[.!?。！？]*", t) for t in texts]
