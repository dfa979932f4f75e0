"""Vectors in step with their texts: uploads, resets, sizes, and a stream that is stopped and started."""

import pytest

from inkloom.sources import stored
from inkloom.streaming import embeddings

SCHEMA = "book_id bigint, source_id bigint, text string"


@pytest.fixture
def store(spark, tmp_path):
    return stored.Store(spark, f"file://{tmp_path}/store")


def held(store):
    return sorted((r.book_id, r.source_id) for r in store.read("chapters").collect())


def test_only_changes_are_embedded(spark, store):
    rows = lambda *r: spark.createDataFrame(r, SCHEMA)
    assert embeddings.sync(store, rows((1, 1, "a b"), (1, 2, "c"), (2, 1, "d"), (2, 2, " "), (2, 3, None))) == {"embedded": 3, "skipped": 0, "deleted": 0}
    before = {r.source_id: r.vector for r in store.read("chapters").where("book_id = 1").collect()}
    assert embeddings.sync(store, rows((1, 1, "a b "), (1, 2, "changed"), (1, 3, "new"))) == {"embedded": 2, "skipped": 1, "deleted": 0}
    after = {r.source_id: r.vector for r in store.read("chapters").where("book_id = 1").collect()}
    assert after[1] == before[1] and after[2] != before[2] and held(store) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert embeddings.sync(store, rows((1, 3, "new"), (1, 2, "")), reset=True) == {"embedded": 0, "skipped": 1, "deleted": 2}
    assert held(store) == [(1, 3), (2, 1)]
    with pytest.raises(ValueError, match="not of 32"):
        embeddings.sync(store, rows((1, 9, "x")), size=32)
    assert embeddings.sync(store, rows((1, 3, "new")), model="other") == {"embedded": 1, "skipped": 0, "deleted": 0}


def test_services_get_short_lists(spark, store):
    def service(texts):
        assert len(texts) <= 7
        return [[float(len(t)), 1.0] for t in texts]

    rows = spark.createDataFrame([(1, i, "x" * i) for i in range(1, 40)], SCHEMA)
    assert embeddings.sync(store, rows, vectors=embeddings.batched(service, 7), size=2)["embedded"] == 39
    assert {r.source_id: r.vector[0] for r in store.read("chapters").collect()} == {i: float(i) for i in range(1, 40)}
    bad = spark.createDataFrame([(2, 1, "y")], SCHEMA)
    for wrong in (lambda texts: [], lambda texts: [[1.0]] * len(texts)):
        with pytest.raises(Exception, match="vectors for|was expected"):
            embeddings.sync(store, bad, vectors=embeddings.batched(wrong), size=2)
    assert {r.book_id for r in store.read("chapters").collect()} == {1}


def test_a_stream_over_three_uploads(spark, store, tmp_path):
    folder, state = f"{tmp_path}/in", f"{tmp_path}/state"
    uploads = [[(1, 1, "one"), (2, 1, "two")], [(1, 1, "one"), (1, 2, "more"), (2, 1, "two again")], [(3, 1, "three")]]
    versions = []
    for rows in uploads:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        embeddings.follow(spark.readStream.schema(SCHEMA).parquet(folder), store, state).awaitTermination()
        versions.append(store.version())
    assert versions == [1, 2, 3] and held(store) == [(1, 1), (1, 2), (2, 1), (3, 1)]
    touched = {r.source_id: r.hash for r in store.read("chapters", version=1).where("book_id = 1").collect()}
    assert {r.source_id: r.hash for r in store.read("chapters").where("book_id = 1 AND source_id = 1").collect()} == touched
    embeddings.follow(spark.readStream.schema(SCHEMA).parquet(folder), store, state).awaitTermination()
    assert store.version() == 3
    # A batch that comes again, as after a failure between the store's commit and the stream's, changes nothing.
    assert embeddings.sync(store, spark.createDataFrame(uploads[0], SCHEMA), batch=2) is None and store.version() == 3
