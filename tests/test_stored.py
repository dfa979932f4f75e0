"""Stored tables: versions, units, conflicts, lost jobs, tombstones."""

import pytest
from pyspark.sql import functions as F

from inkloom.sources import stored


def books(spark, *titles):
    return spark.createDataFrame([(t, f"by {t}") for t in titles], "title string, author string")


def chapters(spark, *rows):
    return spark.createDataFrame(rows, "title string, chapter_index bigint, words bigint")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def store(spark, tmp_path):
    return stored.Store(spark, f"file://{tmp_path}/store")


def test_titles_keep_their_latest_id_and_chapters_are_replaced(spark, store):
    assert store.version() == 0 and store.read("books") is None
    assert stored.add_books(store, books(spark, "b", "a"), chapters(spark, ("a", 1, 10), ("a", 2, 20), ("b", 1, 5))).commit() == 1
    assert rows(store.read("books"), "title", "book_id") == [("a", 1), ("b", 2)]
    stored.add_books(store, books(spark, "a", "c"), chapters(spark, ("a", 1, 11), ("c", 1, 7))).commit()
    assert rows(store.read("chapters"), "book_id", "chapter_index", "words") == [(1, 1, 11), (2, 1, 5), (3, 1, 7)]
    stored.add_books(store, books(spark, "a"), chapters(spark, ("a", 9, 9)), reuse=False).commit()
    assert rows(store.read("books"), "title", "book_id") == [("a", 1), ("a", 4), ("b", 2), ("c", 3)]
    stored.add_books(store, books(spark, "a"), chapters(spark)).commit()
    assert rows(store.read("chapters"), "book_id", "words") == [(1, 11), (2, 5), (3, 7)]
    assert rows(store.read("chapters", version=1), "book_id", "words") == [(1, 10), (1, 20), (2, 5)]


def test_a_change_that_is_lost_leaves_the_version_before(spark, store):
    stored.add_books(store, books(spark, "a"), chapters(spark, ("a", 1, 1))).commit()
    lost = stored.add_books(store, books(spark, "a", "z"), chapters(spark, ("a", 1, 2), ("z", 1, 3)))
    assert rows(lost.read("chapters"), "book_id", "words") == [(1, 2), (2, 3)]
    assert rows(store.read("chapters"), "book_id", "words") == [(1, 1)] and store.version() == 1
    half = store.begin()
    with pytest.raises(Exception, match="broken"):
        half.upsert("books", books(spark, "q").selectExpr("8L AS book_id", "title", "raise_error('broken') AS author"), ["book_id"])
    assert rows(store.read("books"), "title") == [("a",)]
    stored.add_books(store, books(spark, "b"), chapters(spark, ("b", 1, 4))).commit()
    assert rows(store.read("chapters"), "book_id", "words") == [(1, 1), (2, 4)]
    assert store.expire(keep=1) > 0
    assert rows(store.read("chapters"), "book_id", "words") == [(1, 1), (2, 4)]


def test_of_two_changes_one_is_refused(spark, store):
    first = stored.add_books(store, books(spark, "a"), chapters(spark, ("a", 1, 1)))
    second = stored.add_books(store, books(spark, "b"), chapters(spark, ("b", 1, 2)))
    assert first.commit() == 1
    with pytest.raises(stored.Conflict):
        second.commit()
    assert rows(store.read("books"), "title") == [("a",)]


def test_cascades_reach_every_table_and_books_may_come_back(spark, store):
    stored.add_books(store, books(spark, "a", "b"), chapters(spark, ("a", 1, 1), ("b", 1, 2))).commit()
    profiles = spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "book_id bigint, character_id bigint, text string")
    stored.save_profiles(store, profiles).commit()
    store.begin().delete(spark.createDataFrame([(1,)], "book_id bigint")).commit()
    assert [rows(store.read(t), "book_id") for t in ("books", "chapters", "profiles")] == [[(2,)]] * 3
    assert rows(store.read("profiles", version=2), "book_id") == [(1,), (2,)]
    stored.save_profiles(store, profiles.where("book_id = 1").selectExpr("book_id", "character_id", "'back' AS text")).commit()
    assert rows(store.read("profiles"), "book_id", "text") == [(1, "back"), (2, "y")] and rows(store.read("chapters"), "book_id") == [(2,)]
    both = store.begin().upsert("profiles", profiles, ["book_id", "character_id"]).delete(spark.createDataFrame([(2,)], "book_id bigint"))
    both.commit()
    assert rows(store.read("profiles"), "book_id", "text") == [(1, "x")] and rows(store.read("books"), "book_id") == []


def test_profiles_replace_all_columns(spark, store):
    make = lambda *r: spark.createDataFrame(r, "book_id bigint, character_id bigint, text string, mood string")
    stored.save_profiles(store, make((1, 1, "a", "calm"), (1, 2, "b", None))).commit()
    stored.save_profiles(store, make((1, 1, None, "angry"), (2, 1, "c", "x"))).commit()
    assert sorted(store.read("profiles").collect(), key=str) == sorted(make((1, 1, None, "angry"), (1, 2, "b", None), (2, 1, "c", "x")).collect(), key=str)


def test_edges_take_their_events_with_them(spark, store):
    nodes = spark.createDataFrame([(1, "n1", "x"), (1, "n2", "y")], "book_id bigint, node_key string, name string")
    edges = spark.createDataFrame([(1, "e1", "old"), (1, "e2", "old")], "book_id bigint, edge_key string, status string")
    events = spark.createDataFrame([(1, "e1", 1), (1, "e1", 2), (1, "e2", 3), (1, "e9", 4)], "book_id bigint, edge_key string, chapter int")
    stored.merge_graph(store, nodes, edges, events).commit()
    assert rows(store.read("edge_events"), "edge_key", "chapter") == [("e1", 1), ("e1", 2), ("e2", 3)]
    stored.merge_graph(store, nodes.where("node_key = 'n1'").selectExpr("book_id", "node_key", "'z' AS name"), edges.where("edge_key = 'e1'").selectExpr("book_id", "edge_key", "'new' AS status"), events.where("chapter = 2")).commit()
    assert rows(store.read("edges"), "edge_key", "status") == [("e1", "new"), ("e2", "old")] and rows(store.read("nodes"), "name") == [("y",), ("z",)]
    assert rows(store.read("edge_events"), "edge_key", "chapter") == [("e1", 2), ("e2", 3)]


def people(spark, *rows):
    return spark.createDataFrame(rows, "book_id bigint, want_id bigint, character_id bigint, name string, aliases array<string>")


def test_two_syncs_give_one_node_and_edges_stay(spark, store):
    pairs = lambda *r: spark.createDataFrame(r, "book_id bigint, source bigint, target bigint, summary string")
    lines = lambda *r: spark.createDataFrame(r, "source bigint, target bigint, chapter int")
    stored.sync_subgraph(store, people(spark, (1, 1, 7, "甲", []), (1, 2, None, "阿乙", []), (2, 3, None, "阿乙", [])), pairs((1, 1, 2, "old"), (2, 3, 3, "self")), lines((1, 2, 4), (1, 2, 5))).commit()
    stub = next(r.node_key for r in store.read("nodes").collect() if r.name == "阿乙" and r.book_id == 1)
    assert stub.startswith("stub:1:")
    # The mere name gets an id under another name with the old one as an alias; the other book's stub of that name stays.
    stored.sync_subgraph(store, people(spark, (1, 1, 9, "乙姑娘", [" 阿 乙"]), (1, 2, 7, "甲", ["甲甲"])), pairs((1, 1, 2, "back")), lines((1, 2, 8))).commit()
    nodes = {(r.book_id, r.node_key): (r.character_id, r.name) for r in store.read("nodes").collect()}
    assert nodes[1, stub] == (9, "乙姑娘") and len(nodes) == 3 and nodes[1, "character:1:7"] == (7, "甲")
    assert sorted((r.source_key, r.target_key, r.summary) for r in store.read("edges").where("book_id = 1").collect()) == sorted([("character:1:7", stub, "old"), (stub, "character:1:7", "back")])
    # A mention by the new name finds the node by that name no more as a stub, but a mention with the id does; and a name alone doesn't rename it.
    stored.sync_subgraph(store, people(spark, (1, 1, 7, "甲", []), (1, 2, 9, "乙", [])), pairs((1, 1, 2, "new")), lines((1, 2, 6))).commit()
    assert rows(store.read("edge_events").where("book_id = 1"), "edge_key", "chapter") == sorted([(f"character:1:7|{stub}", 6), (f"{stub}|character:1:7", 8)])
    assert {r.name for r in store.read("nodes").where(f"node_key = '{stub}'").collect()} == {"乙"}


def test_rows_are_stored_as_one(spark):
    from inkloom.operators import relations

    kind = "source_id bigint, ord bigint, target_id bigint, target_name string, summary string, acts array<string>, stability string, history array<struct<chapter_start:bigint,chapter_end:bigint,relation_type:string,polarity:string,strength:string,summary:string>>"
    event = lambda a, z, t="ally", s="x": (a, z, t, "positive", "high", s)
    given = [
        (1, 1, 0, "A b", " first ", ["x", " y ", "", None, "x"], None, [event(5, 7)]), (1, 2, 8, "a B", "first", ["z", "y"], " firm ", [event(8, 9, s="later"), event(20, 21)]), (1, 3, 9, "AB", "", None, "loose", [event(20, 21, "foe")]),
        (1, 4, 0, "  ", "nobody", [], "", []), (1, 5, 0, None, "nobody", [], "", []), (2, 1, 0, "C", None, None, None, None),
    ]
    got = {(r.source_id, r.name_key): r for r in relations.stored_rows(spark.createDataFrame(given, kind), ["acts"], ["stability"]).collect()}
    assert set(got) == {(1, "ab"), (2, "c")}
    r = got[1, "ab"]
    assert (r.target_id, r.target_name, r.summary, r.acts, r.stability, r.first_chapter, r.last_chapter) == (8, "a B", "first", ["x", "y", "z"], "firm", 5, 21)
    assert [(h.chapter_start, h.chapter_end, h.relation_type) for h in r.history] == [(5, 9, "ally"), (20, 21, "ally"), (20, 21, "foe")]
    c = got[2, "c"]
    assert (c.target_id, c.target_name, c.summary, c.acts, c.stability, c.first_chapter, c.last_chapter, c.history) == (0, "C", "", [], "", 0, 0, None)


def test_merged_edges_are_made_once(spark, store):
    """What a merge asks of its nodes and edges doesn't make them again."""
    seen = spark.sparkContext.accumulator(0)

    def name(i):
        seen.add(1)
        return f"e{i}"

    edges = spark.range(1, 4).select(F.lit(1).cast("bigint").alias("book_id"), F.udf(name, "string")("id").alias("edge_key"), F.lit("new").alias("status"))
    nodes = spark.createDataFrame([(1, "n1", "x")], "book_id bigint, node_key string, name string")
    stored.merge_graph(store, nodes, edges, spark.createDataFrame([(1, "e1", 1), (1, "e9", 4)], "book_id bigint, edge_key string, chapter int")).commit()
    assert rows(store.read("edges"), "edge_key") == [("e1",), ("e2",), ("e3",)] and rows(store.read("edge_events"), "edge_key", "chapter") == [("e1", 1)]
    assert seen.value == 3
