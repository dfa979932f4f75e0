"""The search over cells against a search of all points."""

import random

from pyspark.sql import functions as F

from inkloom.operators import cells, retrieval
from inkloom.sources import tables


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in df.collect())


def test_the_same_as_all_points_and_fewer_read(spark):
    draw = random.Random(2)
    centres = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    points = [(i, i % 3, [c + draw.gauss(0, 0.03) for c in centres[i % 12]]) for i in range(900)]
    points += [(1000 + i, 1, centres[0]) for i in range(40)] + [(2000, 1, [0.0] * 6), (2001, 1, None)]
    given = spark.createDataFrame(points, "id bigint, book_id int, vector array<double>")
    queries = spark.createDataFrame([(k, k % 4, [c + draw.gauss(0, 0.05) for c in centres[k % 12]]) for k in range(20)] + [(99, 1, [0.0] * 6)], "query_id int, book_id int, vector array<double>")
    made = cells.index(given, cells=12)
    for most in (1, 7, 60, 400):
        want = rows_of(retrieval.dense(queries, given, most))
        assert rows_of(cells.dense(queries, made, most)) == want and want
    _, first, second = cells.visits(queries, made, 7)
    read = first.select("n").unionAll(second.select("n")).agg(F.sum("n")).first()[0]
    pairs = queries.join(given, "book_id").count()
    assert read < pairs / 3
    assert rows_of(cells.dense(queries, cells.index(given, cells=1, sample=5), 7)) == rows_of(retrieval.dense(queries, given, 7))
    assert cells.dense(queries, cells.index(given.limit(0)), 7).count() == 0 and cells.dense(queries.limit(0), made, 7).count() == 0


def test_the_given_vectors(spark, small):
    rows = tables.table(spark, small, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("label").alias("book_id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "book_id", "vector")
    assert rows_of(cells.dense(queries, cells.index(rows), 10)) == rows_of(retrieval.dense(queries, rows, 10))


def test_blocks_and_parts(spark, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 7)
    monkeypatch.setattr(cells, "PART", 3)
    draw = random.Random(6)
    points = [(i, i % 2, [float(draw.randrange(-3, 4)) for _ in range(4)]) for i in range(200)]
    given = spark.createDataFrame(points, "id bigint, book_id int, vector array<double>")
    queries = given.where("id < 20").select(F.col("id").alias("query_id"), "book_id", "vector")
    for most in (1, 5, 150):
        assert rows_of(cells.dense(queries, cells.index(given, cells=3), most)) == rows_of(retrieval.dense(queries, given, most))
