"""Queries over stored tables: several changes in a row, and what is stored after them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkloom.operators import cells
from inkloom.operators.components import shared_dir, written
from inkloom.plans.base import EVENTS, query
from inkloom.sources import stored, tables
from inkloom.streaming import embeddings


def new_store(spark) -> stored.Store:
    """A store of its own in the shared folder."""
    return stored.Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")


@query("""WITH d AS (SELECT source AS title, doc_id, lang, n_chars FROM documents), first AS (SELECT title, row_number() OVER (ORDER BY title) AS book_id FROM (SELECT DISTINCT title FROM d)),
again AS (SELECT title FROM first WHERE book_id % 2 = 1 UNION ALL SELECT 'new ' || title FROM first WHERE book_id % 3 = 0),
ids AS (SELECT title, book_id FROM first UNION ALL SELECT title, (SELECT max(book_id) FROM first) + row_number() OVER (ORDER BY title) FROM again WHERE title NOT IN (SELECT title FROM first)),
ch AS (SELECT book_id, doc_id, n_chars FROM d JOIN first USING (title) WHERE lang = 'en' AND book_id % 2 = 0 UNION ALL SELECT book_id, doc_id, n_chars FROM d JOIN first USING (title) WHERE book_id % 2 = 1
  UNION ALL SELECT ids.book_id, doc_id, n_chars FROM d JOIN first f USING (title) JOIN ids ON ids.title = 'new ' || d.title WHERE f.book_id % 3 = 0),
ve AS (SELECT label + 1 AS book_id, vec_id FROM embeddings)
SELECT ids.book_id::BIGINT AS book_id, title, count(doc_id) AS chapters, coalesce(sum(n_chars), 0)::BIGINT AS chars, coalesce((SELECT count(*) FROM ve WHERE ve.book_id = ids.book_id), 0)::BIGINT AS vectors
FROM ids LEFT JOIN ch ON ids.book_id = ch.book_id WHERE ids.book_id % 5 <> 0 GROUP BY ids.book_id, title""")
def stored_books(spark, sf_dir):
    """Sources are stored as books with their English documents as chapters; every second is uploaded again with all its documents, some under a new title; vectors join them; every fifth book is deleted from all tables."""
    store = new_store(spark)
    docs = tables.table(spark, sf_dir, "documents", "source", "doc_id", "lang", "n_chars").withColumnRenamed("source", "title")
    stored.add_books(store, docs.select("title").distinct(), docs.where("lang = 'en'")).commit()
    ids = store.read("books").select("title", F.col("book_id").alias("_id"))
    odd = docs.join(ids.where("_id % 2 = 1"), "title").drop("_id")
    renamed = docs.join(ids.where("_id % 3 = 0"), "title").drop("_id").withColumn("title", F.concat(F.lit("new "), "title"))
    uploaded = odd.unionByName(renamed)
    stored.add_books(store, uploaded.select("title").distinct(), uploaded).commit()
    vectors = tables.table(spark, sf_dir, "embeddings", "vec_id", "label").select((F.col("label") + 1).cast("bigint").alias("book_id"), "vec_id")
    store.begin().replace("vectors", vectors).commit()
    store.begin().delete(store.read("books").where("book_id % 5 = 0")).commit()
    chapters = store.read("chapters").groupBy("book_id").agg(F.count(F.lit(1)).alias("chapters"), F.sum("n_chars").alias("chars"))
    counted = store.read("vectors").groupBy("book_id").agg(F.count(F.lit(1)).alias("vectors"))
    found = store.read("books").join(chapters, "book_id", "left").join(counted, "book_id", "left")
    return found.select("book_id", "title", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("chapters", "chars", "vectors")])


@query(f"""WITH {EVENTS}, e AS (SELECT source_id % 5 AS book_id, source_id || '-' || target_id AS edge_key, * FROM rel), two AS (SELECT *, polarity = 'positive' AND chapter_start > 40 AS late, chapter_start <= 40 AS early FROM e),
again AS (SELECT DISTINCT edge_key FROM two WHERE late), kept AS (SELECT * FROM two WHERE late OR (early AND edge_key NOT IN (SELECT edge_key FROM again)))
SELECT book_id, edge_key, arg_max(polarity, (chapter_end, summary, polarity, strength)) AS status, count(*) AS n_events, sum(chapter_end)::BIGINT AS ends FROM kept GROUP BY book_id, edge_key""")
def stored_graph(spark, sf_dir):
    """A graph merged twice: the second merge replaces the edges that it has, with all their events."""
    store = new_store(spark)
    # The lines meet their orders once; the rest goes over what is left of them.
    rel = written(tables.relation_events(spark, sf_dir).select("source_id", "target_id", "chapter_start", "chapter_end", "polarity", "strength", "summary"))
    rel = rel.withColumns({"book_id": F.col("source_id") % 5, "edge_key": F.concat_ws("-", F.col("source_id").cast("string"), F.col("target_id").cast("string"))})
    for part in (rel.where("chapter_start <= 40"), rel.where("chapter_start > 40 AND polarity = 'positive'")):
        ends = part.select("book_id", F.explode(F.array("source_id", "target_id")).alias("node")).select("book_id", F.col("node").cast("string").alias("node_key")).distinct()
        # An edge's last events decide, so only they are sorted.
        last = part.groupBy(F.col("book_id").alias("_b"), F.col("edge_key").alias("_e")).agg(F.max("chapter_end").alias("_end"))
        decisive = part.join(F.broadcast(written(last)), (F.col("book_id") == F.col("_b")) & (F.col("edge_key") == F.col("_e")) & F.col("chapter_end").eqNullSafe(F.col("_end")))
        edges = decisive.groupBy("book_id", "edge_key").agg(F.max_by("polarity", F.struct("chapter_end", "summary", "polarity", "strength")).alias("status"))
        stored.merge_graph(store, ends, edges, part.select("book_id", "edge_key", "chapter_start", "chapter_end", "summary")).commit()
    events = store.read("edge_events").groupBy("book_id", "edge_key").agg(F.count(F.lit(1)).alias("n_events"), F.sum("chapter_end").alias("ends"))
    return store.read("edges").join(events, ["book_id", "edge_key"]).select("book_id", "edge_key", "status", "n_events", "ends")


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN trim(text) || ' again' ELSE trim(text) END AS text, doc_id % 7 + 1 AS book_id, lang, trim(text) AS first FROM documents WHERE doc_id % 3 <> 0),
s AS (SELECT *, sha256('hashed-64' || chr(10) || text) AS hash FROM d) SELECT doc_id, book_id, hash FROM s WHERE text <> ''""")
def embedding_sync(spark, sf_dir):
    """Three uploads of documents: the English ones; all, some of them changed; without every third, which then goes."""
    store = new_store(spark)
    docs = tables.table(spark, sf_dir, "documents", "doc_id", "text", "lang").select((F.col("doc_id") % 7 + 1).alias("book_id"), F.col("doc_id").alias("source_id"), F.trim("text").alias("text"), "lang")
    changed = docs.withColumn("text", F.when(F.col("source_id") % 10 == 0, F.concat("text", F.lit(" again"))).otherwise(F.col("text")))
    for rows, reset in ((docs.where("lang = 'en'"), False), (changed, False), (changed.where("source_id % 3 <> 0"), True)):
        embeddings.sync(store, rows.drop("lang"), reset=reset)
    return store.read("chapters").select(F.col("source_id").alias("doc_id"), "book_id", "hash")


@query(r"""WITH p AS (SELECT a.c_custkey AS k, (a.c_custkey - 1) // 2 % 5 AS book_id, b.c_custkey AS e, 'stub:' || ((a.c_custkey - 1) // 2 % 5) || ':' || substr(sha1(lower(regexp_replace(b.c_name, '\s+', '', 'g'))), 1, 12) AS stub FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 2 = 1),
n AS (SELECT book_id, 'character:' || book_id || ':' || k AS node_key, k AS character_id, 1 + CASE WHEN e % 4 = 2 THEN 1 ELSE 0 END AS n_edges FROM p UNION ALL SELECT book_id, stub, CASE WHEN e % 4 = 2 THEN e ELSE 0 END, 1 + CASE WHEN e % 4 = 2 THEN 1 ELSE 0 END FROM p)
SELECT book_id::BIGINT AS book_id, node_key, character_id::BIGINT AS character_id, n_edges::BIGINT AS n_edges FROM n""")
def subgraph_sync(spark, sf_dir):
    """Every odd customer is synced with the next one as a mere name; then half of the others with their ids, which the stubs of their names take over."""
    store = new_store(spark)
    c = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name")
    n = F.col("c_custkey").cast("bigint")
    people = c.select((F.floor((n - 1) / 2) % 5).cast("bigint").alias("book_id"), n.alias("want_id"), n.alias("character_id"), F.col("c_name").alias("name"), F.array(F.concat(F.lit(" "), F.upper("c_name"))).alias("aliases"))
    pairs = c.where("c_custkey % 2 = 1").join(c.select((F.col("c_custkey") - 1).alias("_k")), F.col("c_custkey") == F.col("_k")).select((F.floor((n - 1) / 2) % 5).cast("bigint").alias("book_id"), n.alias("source"), (n + 1).alias("target"))
    ends = pairs.select(F.explode(F.array("source", "target")).alias("want_id"))
    people = people.join(ends, "want_id", "left_semi")
    events = pairs.select("source", "target", F.lit(1).alias("chapter_start"))
    stubs = people.withColumn("character_id", F.when(F.col("want_id") % 2 == 1, F.col("character_id")))
    stored.sync_subgraph(store, stubs, pairs, events).commit()
    again = pairs.where("target % 4 = 2").select("book_id", F.col("target").alias("source"), F.col("source").alias("target"))
    known = people.join(again.select(F.explode(F.array("source", "target")).alias("want_id")), "want_id", "left_semi")
    stored.sync_subgraph(store, known, again, again.select("source", "target", F.lit(2).alias("chapter_start"))).commit()
    degree = store.read("edges").select("book_id", F.explode(F.array("source_key", "target_key")).alias("node_key")).groupBy("book_id", "node_key").agg(F.count(F.lit(1)).alias("n_edges"))
    return store.read("nodes").join(degree, ["book_id", "node_key"], "left").select("book_id", "node_key", F.coalesce("character_id", F.lit(0)).alias("character_id"), F.coalesce("n_edges", F.lit(0).cast("bigint")).alias("n_edges"))


@query("""WITH d AS (SELECT q.vec_id AS query_id, p.vec_id AS id, list_cosine_similarity(p.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings p ON q.label = p.label AND q.vec_id % 20 = 0)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, id) AS rank, round(s, 6) + 0.0 AS score FROM d QUALIFY rank <= 10""")
def dense_cells(spark, sf_dir):
    """Every twentieth vector's nearest ones of its label, by cells that can hold them."""
    rows = tables.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("label").alias("book_id"), F.col("embedding").alias("vector"))
    found = cells.dense(rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "book_id", "vector"), cells.index(rows), 10)
    return found.select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), (F.round("score", 6) + 0.0).alias("score"))
