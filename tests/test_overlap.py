"""The sparse search both ways, and rows before across stretches."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import ranks, retrieval


@pytest.mark.parametrize("most, counts", [(3, 4_000_000), (3, 30), (200, 7)])
def test_both_ways_give_the_same(spark, monkeypatch, most, counts):
    draw = random.Random(most)
    text = lambda n: " ".join(f"w{draw.randrange(12)}" for _ in range(n))
    questions = spark.createDataFrame([(f"q{i}", text(draw.randrange(0, 9))) for i in range(15)] + [("empty", ""), ("null", None)], "query_id string, query string")
    documents = spark.createDataFrame([(i * 7 % 101, text(draw.randrange(0, 12))) for i in range(101)] + [(500, None)], "id bigint, text string").repartition(3)
    monkeypatch.setattr(retrieval, "MOST_COUNTS", counts)
    rows = lambda b: sorted((r.query_id, r.sparse_rank, r.id, r.sparse_score) for r in retrieval.overlap_topk(questions, documents, most, b).collect())
    assert rows(0) == rows(1 << 20) and len(rows(0)) > 30
    assert retrieval.overlap_topk(questions.limit(0), documents, most).count() == 0 and retrieval.overlap_topk(questions, documents.limit(0), most).count() == 0


@pytest.mark.parametrize("width", [1, 4, 1000])
def test_previous_rows(spark, width):
    draw = random.Random(width)
    rows = [(k, n, draw.choice([None, f"v{n}"])) for k in (None, 1, 2) for n in sorted(draw.sample(range(60), 20))]
    got = {(r.k, r.n): r.before for r in ranks.previous(spark.createDataFrame(rows, "k int, n int, v string"), "k", "n", "v", "before", width).collect()}
    want = {(k, n): next((v for kk, m, v in reversed(rows) if kk == k and m < n), None) for k, n, _ in rows}
    assert got == want and ranks.previous(spark.createDataFrame([], "k int, n int, v string"), "k", "n", "v", "before").where(F.lit(True)).count() == 0


def test_products_of_sparse_vectors_are_dealt_over_tasks(spark, monkeypatch):
    """More products take more tasks, none of which holds more than its share."""
    monkeypatch.setattr(retrieval, "MOST_PRODUCTS", 100, raising=False)
    rows = spark.range(2000).selectExpr("id DIV 10 AS id", "id % 50 AS index", "id % 7 AS value")
    found = retrieval.sparse_dot(rows.where("id % 20 = 0"), rows)
    vectors = {}
    for r in rows.collect():
        vectors.setdefault(r.id, {})[r["index"]] = r.value
    expected = {(a, b): sum(x * y[i] for i, x in v.items() if i in y) for a, v in vectors.items() if a % 20 == 0 for b, y in vectors.items() if set(v) & set(y)}
    assert {(r.left_id, r.right_id): r.dot for r in found.collect()} == expected
    assert found.rdd.getNumPartitions() == 4000 // 100
