"""Book sources, slicing, JSON and text functions on hand-made inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from inkloom.functions import jsonx, keys, text
from inkloom.operators import planner
from inkloom.sources import books


def test_decoding():
    assert books.decoded("﻿第一章".encode()) == "第一章"
    assert books.decoded("第一章 开始".encode("gb18030")) == "第一章 开始"
    assert books.decoded(b"ok") == "ok" and books.decoded(b"\xff\xff\xff") == ""


@pytest.fixture()
def shelf(tmp_path):
    page = lambda body: f"<html><head></head><body>{body}</body></html>"
    with zipfile.ZipFile(tmp_path / "b.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:c"><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></container>')
        docs = {"cover": "<p>cover</p>", "intro": "<p>before&nbsp;all</p>", "c1": "<h1>One</h1><p>first</p>", "c1b": "<p>more</p><p></p><p></p><p>end</p>", "c2": "<h2>Two</h2>x<br/>y", "nav": "<p>One Two</p>"}
        items = "".join(f'<item id="{k}" href="t/{k}.xhtml" properties="{"nav" if k == "nav" else ""}"/>' for k in docs)
        z.writestr("OPS/p.opf", f'<package xmlns="o"><metadata><title>T</title><creator>A</creator></metadata><manifest>{items}</manifest><spine>{"".join(f"<itemref idref={chr(34)}{k}{chr(34)}/>" for k in docs)}</spine></package>')
        for k, body in docs.items():
            z.writestr(f"OPS/t/{k}.xhtml", page(body))
    (tmp_path / "a.txt").write_bytes("第1章 起\n你好。".encode("gb18030"))
    (tmp_path / "other.pdf").write_bytes(b"%PDF")
    return str(tmp_path)


def test_files(spark, shelf):
    files = books.read_files(spark, shelf)
    assert {r.kind for r in files.collect()} == {"txt", "epub"}
    assert [r.text for r in books.read_texts(files).collect()] == ["第1章 起\n你好。"]
    docs = books.read_epubs(files)
    assert [r.doc for r in docs.orderBy("place").collect()] == ["OPS/t/intro.xhtml", "OPS/t/c1.xhtml", "OPS/t/c1b.xhtml", "OPS/t/c2.xhtml"]
    got = books.epub_chapters(docs).orderBy("chapter_index").collect()
    assert [(r.chapter_index, r.title) for r in got] == [(1, books.PREFACE), (2, "One"), (3, "Two")]
    assert got[0].content == "before all" and got[1].content == "One\n\nfirst\n\nmore\n\nend"
    assert books.epub_title(open(shelf + "/b.epub", "rb").read()) == {"title": "T", "creator": "A", "description": ""}


def test_slicing(spark):
    sentence = "字" * 3489 + "。"
    parts = books.split_long(sentence * 3 + "尾" * 1489 + "。")
    assert [len(p) for p in parts] == [3490, 3490, 3490, 1490]
    df = spark.createDataFrame([(1, "序\n第1章 起\n你好\n第二章 承\n再见"), (2, "x" * 10), (3, None), (4, "第一节 a\nb")], "book_id bigint, text string")
    got = [(r.book_id, r.chapter_index, r.title, r.content) for r in books.sliced(df).orderBy("book_id", "chapter_index").collect()]
    assert got == [(1, 1, books.PREFACE, "序"), (1, 2, "第1章 起", "你好"), (1, 3, "第二章 承", "再见"), (2, 1, books.WHOLE, "x" * 10), (3, 1, books.WHOLE, ""), (4, 1, "第一节 a", "b")]
    long = books.sliced(spark.createDataFrame([(1, "第1章 长\n" + sentence * 2)], "book_id bigint, text string")).collect()
    assert [(r.title, r.word_count) for r in long] == [("第1章 长-1", 3490), ("第1章 长-2", 3490)]


def test_html_text():
    assert books.html_text("<h1>A &amp; B</h1><p>x\xa0 y</p><script>s</script><div></div><div></div><p>z") == ("A & B\n\nx y\ns\n\nz", ["A & B"])


def test_json(spark):
    rows = ['{"a": 1}', 'text ```json\n{"a": 2}\n``` more', "nothing", None, '{"a": "x"']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    got = {r.i: r.p for r in df.select("i", jsonx.parsed(F.col("raw"), "struct<a:int>").alias("p")).collect()}
    assert got[0].a == 1 and got[1].a == 2 and got[2] is None and got[3] is None and got[4] is None
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [tuple(r) for r in one(jsonx.records(F.lit('[["3", " a "], "b", [7], [2, "c"]]')))] == [(3, "a"), (2, "c")]
    assert [tuple(r) for r in one(jsonx.named_descriptions(F.lit('[{"title": "n", "desc": "d"}, {"desc": "x"}]')))] == [("n", "d")]
    assert one(jsonx.positive_ints(F.array(*map(F.lit, ["3", "x", "-1", "3", "2"])))) == [3, 2]
    assert [one(jsonx.chapter_range(F.lit(t))) for t in ("3-5", "4 ~ 9", "7", "a")] == [(3, 5), (4, 9), (7, 7), None]


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(text.word_count(F.lit("a　b \n c"))) == 3 and one(text.word_count(F.lit(None).cast("string"))) == 0
    assert one(text.overlap_tokens(F.lit("Ab_1 你好吗 x你"))) == ["ab_1", "你好吗", "x", "你", "你好", "好吗"]
    assert one(text.query_terms(F.lit("主角的能力 是 The x"), ["的", "the"])) == ["主角", "能力", "x"]
    assert one(text.question(F.lit(" 谁 "))) == "谁？" and one(text.question(F.lit("谁？"))) == "谁？" and one(text.question(F.lit(""))) == ""
    assert one(text.split_aliases(F.lit(" a / b//a "))) == ["a", "b"] and one(text.file_stem(F.lit('a/b: "c"'))) == "a_b_c_"
    assert one(text.embedding_name(F.lit("n"), F.array(*map(F.lit, ["n", "a", "", "b", "c", "d"])))) == "n、a、b、c"
    assert one(text.escaped_html(F.lit("<a href='x'>&"))) == "&lt;a href=&#x27;x&#x27;&gt;&amp;"
    assert one(keys.retry_delay(F.lit(3))) == 480 and one(keys.retry_delay(F.lit(30))) == 3600
    assert one(keys.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    ids = spark.createDataFrame([("a",), ("a",), (None,)], "k string").select(keys.point_id("k").alias("p"), keys.session_id("k").alias("s")).collect()
    assert ids[0] == ids[1] and ids[0].p >= 0 and len(ids[0].s) == 36


def test_intents(spark):
    asked = {"他为什么叫这个": "identity_ability", "为什么离开": "causal_motivation", "有没有这个人": "existence_check", "他的结局": "ending_fate", "完整剧情": "timeline_evolution", "x": "general_fact", None: "general_fact"}
    df = spark.createDataFrame([(q,) for q in asked], "q string")
    assert {r.q: r.i for r in df.select("q", planner.intent(F.col("q")).alias("i")).collect()} == asked
    parts = df.limit(1).select(planner.parts(F.lit("他是谁？以及他的结局。另外他在哪;还有什么")).alias("p")).first().p
    assert (parts.source, parts.parts) == ("explicit", ["以及他是谁？", "以及他的结局？", "另外他在哪？"])  # the name is what stands before 的


def test_dsn():
    assert books.jdbc_options("mysql+pymysql://u:p@h:3307/db?charset=utf8") == {"url": "jdbc:mysql://h:3307/db", "user": "u", "password": "p"}
    with pytest.raises(ValueError):
        books.jdbc_options("nothing")
