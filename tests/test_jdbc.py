"""DSNs, partitions from histograms and lists of ids against an embedded database."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from inkloom.sources import jdbc


def test_dsns():
    got = jdbc.parsed(" mysql+pymysql://me%40x:p%2Fw%3A@db.host:3307/na%20me ")
    assert got == ("mysql", "db.host", 3307, "me@x", "p/w:", "na me")
    assert jdbc.parsed("mysql://u@h/d") == ("mysql", "h", 3306, "u", "", "d") and jdbc.parsed("postgresql://u:p@h/d").port == 5432
    assert [jdbc.parsed(x) for x in ("", None, "sqlite:///x", "mysql://h/d", "mysql://u:p@h/", "text")] == [None] * 6
    assert jdbc.options("mysql://u:p@h/d") == {"url": "jdbc:mysql://h:3306/d", "user": "u", "password": "p"}
    with pytest.raises(ValueError):
        jdbc.options("nothing")


def test_which_dsn_is_used():
    assert jdbc.resolved({}) == "" and jdbc.resolved({"MYSQL_DSN": "  "}) == ""
    assert jdbc.resolved({"MYSQL_DSN": "mysql://u:p@h/d", "MYSQL_USER": "other"}) == "mysql://u:p@h/d"
    one = jdbc.resolved({"MYSQL_DSN": "mysql://u:change-me-now@h/d", "MYSQL_USER": "a@b", "MYSQL_PASSWORD": "p:w", "MYSQL_DATABASE": "d"})
    assert one == "mysql+pymysql://a%40b:p%3Aw@mysql:3306/d" and jdbc.parsed(one).user == "a@b"
    assert jdbc.resolved({"MYSQL_HOST": "h"}, defaults={"USER": "u", "DATABASE": "x"}) == "mysql+pymysql://u:@h:3306/x"
    assert [jdbc.is_placeholder(x) for x in ("", None, "mysql://u:change-me@h/d", "mysql://u:p@h/d")] == [True, True, True, False]


@given(st.lists(st.integers(-500, 500), min_size=1, max_size=200), st.integers(1, 9), st.integers(1, 40))
def test_ranges_hold_every_value_once(values, partitions, slices):
    low, high = min(values), max(values)
    width = max(1, -(-(high - low + 1) // slices))
    counts = {}
    for v in values:
        counts[(v - low) // width] = counts.get((v - low) // width, 0) + 1
    found = jdbc.ranges(counts.items(), low, width, partitions)
    assert all(sum(a <= v < b for a, b in found) == 1 for v in values) and len(found) <= partitions
    assert all(sum(a <= v < b for v in values) <= len(values) / partitions + max(counts.values()) for a, b in found)


@pytest.fixture(scope="module")
def database(spark):
    draw = random.Random(1)
    how = {"url": "jdbc:derby:memory:books;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    ids = sorted({draw.randrange(1, 200) for _ in range(150)} | {draw.randrange(10**6, 10**9) for _ in range(200)})
    rows = [(i, k % 4, f"chapter {i}") for k, i in enumerate(ids)] + [(None, 1, "no number")]
    frame = spark.createDataFrame(rows, "chapter_index bigint, book_id int, content string")
    frame.write.jdbc(how["url"], "chapters", mode="overwrite", properties={"driver": how["driver"]})
    return how, rows


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_partitions_are_even_and_whole(spark, database):
    how, rows = database
    scanned = jdbc.scan(spark, how, "chapters", "chapter_index", 6)
    assert found(scanned) == sorted(rows, key=str)
    sizes = [len(p) for p in scanned.rdd.glom().collect()]
    # The numbers lie in two far places; a slice is about a million of them, so the lower ones are one slice.
    assert 2 <= len(sizes) <= 6 and max(sizes) <= len(rows) / 6 + sum(1 for i, *_ in rows if i and i < 10**6) + 1
    assert found(jdbc.scan(spark, how, "chapters", "chapter_index", 1)) == sorted(rows, key=str)
    empty = "(SELECT * FROM chapters WHERE \"book_id\" > 9) e"
    assert jdbc.scan(spark, how, empty, "chapter_index", 3).collect() == []


def test_lists_of_ids(spark, database, monkeypatch):
    how, rows = database
    wanted = [i for i, *_ in rows if i][::3]
    ids = spark.createDataFrame([(i,) for i in [*wanted, wanted[0], -5, 0, 77777777777, None]], "id bigint")
    expected = sorted((r for r in rows if r[0] in set(wanted) and r[1] == 1), key=str)
    monkeypatch.setattr(jdbc, "IDS", 50)
    assert len(jdbc.id_conditions("c", wanted, "book_id = 1", 50)) == -(-len(wanted) // 50)
    assert found(jdbc.fetched(spark, how, "chapters", "chapter_index", ids, '"book_id" = 1')) == expected
    monkeypatch.setattr(jdbc, "MOST_IDS", 10)
    assert found(jdbc.fetched(spark, how, "chapters", "chapter_index", ids, '"book_id" = 1')) == expected
    assert jdbc.fetched(spark, how, "chapters", "chapter_index", ids.where("id < 0")).collect() == []
    assert jdbc.id_conditions("c", [3, 1, 3, None, -1]) == ["c IN (1, 3)"]
