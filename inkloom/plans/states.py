"""Queries over states, syncs, ranges, headings and cards."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text
from inkloom.models import edge_sentences
from inkloom.operators import entities, graph, hierarchy, states, sync
from inkloom.plans.base import CHAPTERS, INDEX, VOLUMES, query
from inkloom.sources import jdbc, tables


@query("""SELECT o_orderkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' WHEN 2 THEN 'queued' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 3 > 0 THEN 'now' WHEN o_orderkey % 3 = 0 THEN 'then' END AS started_at, CASE WHEN o_orderkey % 5 = 1 THEN 'now' END AS finished_at,
  CASE WHEN o_orderkey % 5 = 2 THEN o_orderpriority WHEN o_orderkey % 5 > 2 THEN 'old' END AS error FROM orders""")
def job_states(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority")
    k = F.col("o_orderkey")
    jobs = rows.select(k.alias("job_id"), F.col("o_orderstatus").alias("status"), F.when(k % 3 == 0, "then").alias("started_at"), F.lit(None).cast("string").alias("finished_at"), F.lit("old").alias("error"))
    changes = rows.where("o_orderkey % 5 < 3").select(k.alias("job_id"), F.when(k % 5 == 0, "running").when(k % 5 == 1, "completed").otherwise("queued").alias("new_status"), F.when(k % 5 == 2, F.col("o_orderpriority")).otherwise("").alias("message"))
    return states.updated_jobs(jobs, changes, F.lit("now"))


@query("SELECT event_id, event_type AS status, CASE WHEN event_type IN ('running', 'completed', 'error', 'cached') THEN ts END AS started_at, CASE WHEN event_type IN ('completed', 'error', 'cached') THEN ts END AS finished_at FROM (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'running' WHEN 1 THEN 'cached' WHEN 2 THEN 'error' ELSE event_type END AS event_type FROM events)")
def new_jobs(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "ts", "event_type")
    k = F.col("event_id") % 4
    rows = rows.withColumn("status", F.when(k == 0, "running").when(k == 1, "cached").when(k == 2, "error").otherwise(F.col("event_type")))
    return states.created_jobs(rows, F.col("ts")).select("event_id", "status", "started_at", "finished_at")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' WHEN lower(source) = 'src1' AND doc_id % 4 = 1 THEN 'error' WHEN trim(text) <> '' AND doc_id % 3 > 0 THEN 'success' END AS status, CASE WHEN doc_id % 5 IN (0, 1) AND doc_id % 7 > 0 AND length(text) > 500 THEN 'success' WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN 'pending' ELSE 'error' END AS step FROM documents""")
def filled_states(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    k = F.col("doc_id")
    title = F.when((F.lower("source") == "src1") & (k % 4 == 1), "Error").otherwise(F.col("source"))
    status = states.chapter_status(F.when(k % 4 == 0, "old"), title, F.trim("text"), F.when(k % 3 > 0, F.lit("{}")))
    step = states.step_status(F.when(k % 5 == 0, "").when(k % 5 == 1, "pending").otherwise("error"), F.when(k % 7 == 0, "boom"), F.length("text") > 500)
    return rows.select("doc_id", status.alias("status"), step.alias("step"))


@query("SELECT o_orderkey AS plot_id, o_custkey % 15 >= 10 AS exhausted FROM orders WHERE o_orderstatus = 'F'")
def retry_plots(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.col("o_orderkey").alias("plot_id"), F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"), (F.col("o_custkey") % 15).alias("retry_count"))
    of = lambda e: states.retries(rows, e).select("plot_id", F.lit(e).alias("exhausted"))
    return of(True).unionByName(of(False))


@query("""WITH w AS (SELECT vec_id AS id, 'h' || (label % 4) AS hash FROM embeddings WHERE vec_id % 9 <> 0), s AS (SELECT vec_id AS id, 'h' || (label % 3) AS hash FROM embeddings WHERE vec_id % 7 <> 0), l AS (SELECT * FROM w ORDER BY id LIMIT 100)
SELECT l.id, CASE WHEN s.id IS NULL THEN 'insert' WHEN l.hash = s.hash THEN 'skip' ELSE 'update' END AS action, 'limited' AS mode FROM l LEFT JOIN s USING (id) UNION ALL SELECT id, 'skip', 'existing' FROM w""")
def limited_sync(spark, sf_dir):
    rows = states.checked_vectors(tables.table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding").withColumnRenamed("embedding", "vector"), 64)
    of = lambda m, k: rows.where(F.col("vec_id") % k != 0).select(F.col("vec_id").alias("id"), F.concat(F.lit("h"), (F.col("label") % m).cast("string")).alias("hash"))
    limited = states.limited_sync(of(4, 9), of(3, 7), row_limit=100).withColumn("mode", F.lit("limited"))
    return limited.unionByName(states.limited_sync(of(4, 9), of(3, 7), skip_existing=True).withColumn("mode", F.lit("existing")))


@query("SELECT conv_id AS session_id, 'list' AS how FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 3 > 0 UNION ALL SELECT conv_id, 'book' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 7 <> 4")
def session_deletes(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations", "conv_id").distinct().select(F.col("conv_id").alias("session_id"), (F.col("conv_id") % 7).alias("book_id"))
    listed = states.without_sessions(rows, rows.where("session_id % 3 = 0").select(F.concat(F.lit(" "), F.col("session_id").cast("string")).alias("session_id")))
    of_book = states.without_sessions(rows, book_id=4)
    return listed.select("session_id", F.lit("list").alias("how")).unionByName(of_book.select("session_id", F.lit("book").alias("how")))


@query("""WITH e AS (SELECT c_custkey AS source_id, c_name AS n, CASE WHEN c_custkey % 3 = 0 THEN [] WHEN c_custkey % 3 = 1 THEN [{'c': c_nationkey::BIGINT, 't': c_mktsegment}, {'c': 9::BIGINT, 't': c_name}] ELSE [{'c': 4::BIGINT, 't': c_mktsegment}] END AS r FROM customer)
SELECT source_id, u.c AS chapter_index, u.t AS record, n || '：' || u.t AS embedding_text, 'split' AS mode FROM (SELECT source_id, n, unnest(r) AS u FROM e) UNION ALL SELECT source_id, r[1].c, array_to_string(list_transform(r, lambda x: x.t), chr(10)), n || '：' || array_to_string(list_transform(r, lambda x: x.t), chr(10)), 'merged' FROM e WHERE len(r) > 0""")
def record_points(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    record = lambda c, t: F.struct(c.cast("bigint").alias("chapter"), t.alias("text"))
    empty, k = record(F.lit(1), F.lit(" ")), F.col("c_custkey") % 3
    records = F.when(k == 0, F.array(empty)).when(k == 1, F.array(record(F.col("c_nationkey"), F.col("c_mktsegment")), record(F.lit(None), F.lit("lost")), record(F.lit(9), F.col("c_name")))).otherwise(F.array(record(F.lit(4), F.concat("c_mktsegment", F.lit(" ")))))
    entities = rows.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name_text"), records.alias("records"))
    return states.record_points(entities, True).withColumn("mode", F.lit("split")).unionByName(states.record_points(entities, False).withColumn("mode", F.lit("merged")))


@query("SELECT event_id, CASE WHEN event_id % 5 < 4 THEN date_trunc('second', ts) END AS parsed FROM events")
def parsed_times(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "ts")
    k, shown = F.col("event_id") % 5, lambda f: F.date_format("ts", f)
    raw = F.when(k == 0, shown("yyyy-MM-dd HH:mm:ss")).when(k == 1, shown("yyyy-MM-dd'T'HH:mm:ss")).when(k == 2, F.concat(F.lit(" "), shown("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k == 3, F.concat(shown("yyyy-MM-dd HH:mm:ss"), F.lit("+08:00"))).otherwise(shown("dd/MM/yyyy"))
    return rows.select("event_id", states.parsed_time(raw).alias("parsed"))


@query(f"""WITH {CHAPTERS}, n AS (SELECT *, lead(chapter_index) OVER w AS nx, lead(chapter_summary) OVER w AS nh FROM chapters WINDOW w AS (PARTITION BY book_id ORDER BY chapter_index))
SELECT book_id, chapter_index, chapter_index || '|' || chapter_index || '|' || nx || '|' || nx || '|' || left(sha1(trim(chapter_summary)), 16) || '|' || left(sha1(trim(nh)), 16) AS boundary FROM n WHERE nx IS NOT NULL""")
def boundary_hashes(spark, sf_dir):
    rows = tables.cards(spark, sf_dir).select("book_id", "chapter_index", "chapter_summary")
    after = rows.select(F.col("book_id").alias("b"), (F.col("chapter_index") - 1).alias("c"), F.col("chapter_summary").alias("head"))
    both = rows.join(after, (F.col("book_id") == F.col("b")) & (F.col("chapter_index") == F.col("c")))
    at = F.col("chapter_index")
    return both.select("book_id", "chapter_index", states.boundary_hash(at, at, at + 1, at + 1, F.col("chapter_summary"), F.col("head")).alias("boundary"))


# --- ranges

_TOKENED = f"{INDEX}, tk AS (SELECT book_id, chapter_index, [(word_count % 3)::VARCHAR] AS t FROM ci)"


def _single(spark, sf_dir):
    """Every chapter as a range of its own; two neighbours share a token if their word counts are equal modulo 3."""
    rows = tables.word_counts(spark, sf_dir).select("book_id", "chapter_index", "word_count")
    token = F.array((F.col("word_count") % 3).cast("string"))
    return rows.select("book_id", F.col("chapter_index").alias("start"), F.col("chapter_index").alias("end"), token.alias("head"), token.alias("tail"))


def _pass_sql(source: str, name: str) -> str:
    """One pass over disjoint pairs."""
    return f"""{name}a AS (SELECT *, row_number() OVER w - 1 AS n, list_has_any(tail, lead(head) OVER w) AS met FROM {source} WINDOW w AS (PARTITION BY book_id ORDER BY "start")), {name}b AS (SELECT *, bool_or(n % 2 = 0 AND coalesce(met, false)) OVER (PARTITION BY book_id, n // 2) AS j FROM {name}a),
{name} AS (SELECT book_id, min("start") AS "start", max("end") AS "end", arg_min(head, "start") AS head, arg_max(tail, "start") AS tail FROM {name}b GROUP BY book_id, CASE WHEN j THEN n // 2 * 2 ELSE n END)"""


_ROUNDS = 'r0 AS (SELECT book_id, chapter_index AS "start", chapter_index AS "end", t AS head, t AS tail FROM tk), ' + ", ".join(_pass_sql(f"r{i}", f"r{i + 1}") for i in range(8))


@query(f'WITH {_TOKENED}, {_ROUNDS} SELECT book_id, "start", "end" FROM r8')
def stitched_volumes(spark, sf_dir):
    # A pass that changes nothing ends the rounds; further ones would change nothing either.
    return hierarchy.stitched_rounds(_single(spark, sf_dir), 8, disjoint=True)


@query()
def stitched_plots(spark, sf_dir):
    """Rounds of greedy pairs; held against a plain loop in the tests."""
    return hierarchy.stitched_rounds(_single(spark, sf_dir), 5)


@query(f"""WITH {CHAPTERS}, ba AS (SELECT book_id, (chapter_index - 1) // 10 AS batch_no, min(chapter_index) AS low, max(chapter_index) AS high FROM chapters GROUP BY 1, 2), ra AS (SELECT DISTINCT book_id, (chapter_index - 1) // 10 AS batch_no, CASE WHEN word_count % 5 = 0 THEN 0 ELSE chapter_index - word_count % 4 END AS s, CASE WHEN word_count % 7 = 0 THEN 0 ELSE chapter_index + word_count % 9 - 4 END AS e FROM chapters),
g AS (SELECT DISTINCT book_id, batch_no, greatest(low, CASE WHEN s = 0 THEN low ELSE s END) AS "start", least(high, CASE WHEN e = 0 THEN high ELSE e END) AS "end" FROM ra JOIN ba USING (book_id, batch_no)), ok AS (SELECT * FROM g WHERE "start" <= "end")
SELECT * FROM ok UNION ALL SELECT book_id, batch_no, low, high FROM ba WHERE (book_id, batch_no) NOT IN (SELECT (book_id, batch_no) FROM ok)""")
def clamped_ranges(spark, sf_dir):
    rows = tables.word_counts(spark, sf_dir).select("book_id", "chapter_index", "word_count").withColumn("batch_no", F.floor((F.col("chapter_index") - 1) / 10))
    n, at = F.col("word_count"), F.col("chapter_index")
    ranges = rows.select("book_id", "batch_no", F.when(n % 5 == 0, 0).otherwise(at - n % 4).alias("start"), F.when(n % 7 == 0, 0).otherwise(at + n % 9 - 4).alias("end"))
    return hierarchy.clamped(ranges, rows.groupBy("book_id", "batch_no").agg(F.min("chapter_index").alias("low"), F.max("chapter_index").alias("high")))


@query(f"""WITH {INDEX}, p AS (SELECT book_id * 100000 + plot_id AS key, list(chapter_index ORDER BY chapter_index) AS c FROM ci GROUP BY book_id, plot_id), h AS (SELECT *, greatest(1, len(c) // 2) AS m FROM p WHERE len(c) > 1)
SELECT key, 0 AS half, array_to_string(c[1:m], ',') AS chapters FROM h UNION ALL SELECT key, 1, array_to_string(c[m + 1:], ',') FROM h""")
def halved_windows(spark, sf_dir):
    rows = tables.chapter_index(spark, sf_dir).groupBy((F.col("book_id") * 100000 + F.col("plot_id")).alias("key")).agg(F.array_sort(F.collect_list("chapter_index")).alias("chapters"))
    found = hierarchy.halved(rows)
    return found.select("key", "half", F.array_join(F.transform("chapters", lambda c: c.cast("string")), ",").alias("chapters"))


@query(f"WITH {VOLUMES} SELECT ci.book_id, ci.chapter_index, p.start_chapter AS window_start, p.end_chapter AS window_end FROM ci LEFT JOIN plots p ON ci.book_id = p.book_id AND ci.plot_id = p.plot_id")
def plot_windows(spark, sf_dir):
    index = tables.chapter_index(spark, sf_dir)
    plots = index.groupBy("book_id", "plot_id").agg(F.min("chapter_index").alias("window_start"), F.max("chapter_index").alias("window_end"))
    return index.join(plots, ["book_id", "plot_id"], "left").select("book_id", "chapter_index", "window_start", "window_end")


@query(f"WITH {VOLUMES}, f AS (SELECT * FROM plots WHERE plot_id BETWEEN 2 AND 5) SELECT book_id, min(plot_id) AS first_plot, max(plot_id) AS last_plot, min(start_chapter) AS start_chapter, max(end_chapter) AS end_chapter FROM f GROUP BY 1")
def plot_bounds(spark, sf_dir):
    index = tables.chapter_index(spark, sf_dir).where(F.col("plot_id").between(2, 5))
    return index.groupBy("book_id").agg(F.min("plot_id").alias("first_plot"), F.max("plot_id").alias("last_plot"), F.min("chapter_index").alias("start_chapter"), F.max("chapter_index").alias("end_chapter"))


@query("SELECT source, count(*) AS total_chapters, max(doc_id) AS latest FROM documents GROUP BY source ORDER BY latest DESC, source DESC")
def listed_books(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "source").groupBy("source").agg(F.count(F.lit(1)).alias("total_chapters"), F.max("doc_id").alias("latest"))
    return rows.orderBy(F.desc("latest"), F.desc("source"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal <= 5000 AND c_custkey > 0 AND trim(c_name) <> '' AND c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) = 1)")
def single_record_people(spark, sf_dir):
    """Valid characters (not to be deleted, with id and name) that have one record only; a record is a year with orders."""
    people = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal").select(F.col("c_custkey").alias("character_id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 5000, "yes").otherwise("no").alias("need_delete"))
    records = tables.table(spark, sf_dir, "orders", "o_custkey", "o_orderdate").select(F.col("o_custkey").alias("character_id"), F.year("o_orderdate").alias("record"))
    return entities.with_single_record(entities.valid_characters(people), records).select(F.col("character_id").alias("c_custkey"))


@query("SELECT l_suppkey, bool_and(l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) AS complete FROM lineitem GROUP BY 1")
def complete_sets(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag")
    missing = sync.stale(rows.select("l_suppkey", "l_partkey"), rows.select("l_suppkey", "l_partkey").join(rows.where("l_returnflag = 'R'").select("l_partkey").distinct(), "l_partkey", "left_semi").select("l_suppkey", "l_partkey"), ["l_suppkey", "l_partkey"])
    left = missing.select(F.col("l_suppkey").alias("_s")).distinct()
    return rows.select("l_suppkey").distinct().join(left, F.col("l_suppkey") == F.col("_s"), "left").select("l_suppkey", F.col("_s").isNull().alias("complete"))


@query(f"""WITH {CHAPTERS}, w AS (SELECT book_id, (chapter_index - 1) // 5 AS batch_no, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, string_agg(chapter_index || ': ' || chapter_summary, chr(10) ORDER BY chapter_index) AS t FROM chapters GROUP BY 1, 2),
x AS (SELECT *, regexp_extract_all(t, '[^.!?。！？]+[.!?。！？]*') AS s FROM w), y AS (SELECT *, trim(left(trim(s[1]), 120)) AS a, trim(left(trim(list_reduce(s, lambda p, q: CASE WHEN length(q) > length(p) THEN q ELSE p END)), 120)) AS b, trim(left(trim(s[-1]), 120)) AS c FROM x)
SELECT book_id, batch_no, first_chapter, last_chapter, trim(a || CASE WHEN b NOT IN (a, '') THEN ' ' || b ELSE '' END || CASE WHEN c NOT IN (a, b, '') THEN ' ' || c ELSE '' END) AS packet FROM y""")
def compressed_context(spark, sf_dir):
    rows = tables.cards(spark, sf_dir).select("book_id", "chapter_index", F.col("chapter_summary").alias("text"))
    return hierarchy.compressed(rows, 5, edge_sentences())


# --- headings, cards


@query("""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '第3章 ' || source ELSE NULL END AS one, CASE WHEN doc_id % 4 = 1 THEN '第十二节' END AS first, text FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN one WHEN 1 THEN '第十二节' WHEN 2 THEN '第1章 x' END AS heading, sha256(regexp_replace(CASE WHEN doc_id % 4 = 3 THEN text ELSE text END, '^\\s+|\\s+$', '', 'g')) AS rest_sha256 FROM d""")
def stripped_headings(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    k = F.col("doc_id") % 4
    whole = F.when(k == 0, F.concat(F.lit("\n 第3章 "), "source", F.lit("\n"), "text")).when(k == 1, F.concat(F.lit("第十二节\r\n\n"), "text")).when(k == 2, F.concat(F.lit("第1章 \n x\n"), "text")).otherwise(F.col("text"))
    # A heading that lies on two lines is matched as two, and taken off as two.
    title = F.when(k == 2, F.lit("第1章 x")).otherwise(text.heading(F.col("whole")))
    rows = rows.select("doc_id", whole.alias("whole")).select("doc_id", "whole", title.alias("heading"))
    return rows.select("doc_id", "heading", F.sha2(text.without_heading(F.col("whole"), F.col("heading")), 256).alias("rest_sha256"))


@query("""SELECT p_partkey, 'Plot ' || p_partkey || chr(10) || 'Title: ' || p_name || chr(10) || 'Summary: ' || p_type || chr(10) || 'SpecialExistence: ' || p_brand || ': ' || p_name || '；' || p_type || '；x' || chr(10) || 'Organizations: 无' || chr(10) || 'WorldRules: ' || p_type AS card,
  p_name || ': 状态=' || p_brand || '；' || p_type || CASE WHEN p_size % 2 = 0 THEN ' | 能力=' || p_type ELSE '' END || '；' || p_brand || ': 无明显变化' AS changes, CASE WHEN p_size % 3 = 0 THEN p_brand || chr(10) || p_type ELSE p_type END AS message, 'plot_title: ' || p_name || chr(10) || 'summary: ' || p_type AS search_text FROM part""")
def plot_cards(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    name, brand, kind = (F.col(c) for c in ("p_name", "p_brand", "p_type"))
    none = F.array().cast("array<string>")
    of = lambda n, r: F.struct(n.alias("name"), r.alias("records"))
    card = text.plot_card(F.col("p_partkey"), name, kind, F.array(of(brand, F.array(name, kind, brand)), of(F.lit("x"), none), of(F.lit(" "), none)), F.array().cast("array<struct<name:string,records:array<string>>>"), F.array(of(kind, none)))
    change = lambda n, s, k: F.struct(n.alias("name"), s.alias("status_change"), none.alias("relationship_updates"), k.alias("skills"))
    changes = text.deltas(F.array(change(name, F.array(brand, kind, brand), F.when(F.col("p_size") % 2 == 0, F.array(kind)).otherwise(none)), change(F.lit(" "), none, none), change(brand, none, none)), {"status_change": "状态", "relationship_updates": "关系", "skills": "能力"})
    part = lambda t, c: F.struct(t.cast("string").alias("text"), c.cast("string").alias("content"))
    message = text.message_text(F.array(part(F.when(F.col("p_size") % 3 == 0, brand), F.lit(None)), part(F.lit(" "), kind)))
    return rows.select("p_partkey", card.alias("card"), changes.alias("changes"), message.alias("message"), text.labelled_lines(plot_title=name, volume=F.lit(""), summary=kind).alias("search_text"))


@query(f"""WITH {CHAPTERS}, b AS (SELECT book_id, count(*) AS docs, count(*) FILTER (WHERE word_count % 2 = 0) AS headed, max(chapter_index) % 3 AS sliced FROM chapters GROUP BY 1) SELECT book_id, headed >= greatest(3, docs // 3) OR sliced <= 1 AS takes_docs FROM b""")
def docs_or_slices(spark, sf_dir):
    rows = tables.word_counts(spark, sf_dir).select("book_id", "chapter_index", "word_count").groupBy("book_id").agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("word_count") % 2 == 0).alias("headed"), (F.max("chapter_index") % 3).alias("sliced"))
    return rows.select("book_id", text.takes_docs(F.col("headed"), F.col("docs"), F.col("sliced")).alias("takes_docs"))


# --- graph


@query("""WITH e AS (SELECT DISTINCT s_nationkey::BIGINT AS s, c_nationkey::BIGINT AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), k AS (SELECT s || '>' || t AS edge_key, s::VARCHAR AS a, t::VARCHAR AS b FROM e)
SELECT edge_key, '3' AS graph_key, 'node' AS kind FROM k WHERE a = '3' OR b = '3' UNION ALL SELECT edge_key, unnest([a, b]), 'edge' FROM k WHERE edge_key = (SELECT min(edge_key) FROM k)""")
def graph_highlights(spark, sf_dir):
    edges = tables.relation_events(spark, sf_dir).select(F.col("source_id").cast("string").alias("source_key"), F.col("target_id").cast("string").alias("target_key")).distinct().withColumn("edge_key", F.concat_ws(">", "source_key", "target_key"))
    chosen = edges.agg(F.min("edge_key")).first()[0] or ""
    return graph.highlights(edges, "node", "3").withColumn("kind", F.lit("node")).unionByName(graph.highlights(edges, "edge", chosen).withColumn("kind", F.lit("edge")))


@query("""WITH n AS (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'character:' ELSE 'stub:' END || c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS cid, c_name FROM customer WHERE c_custkey % 3 <> 0)
SELECT c.c_custkey AS want_id, c.c_custkey AS character_id, n.k AS old_key FROM customer c JOIN n ON n.c_name = c.c_name AND n.cid = 0 WHERE c.c_custkey % 5 > 0 AND c.c_custkey > 0""")
def stub_upgrades(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name")
    none, k = F.array().cast("array<string>"), F.col("c_custkey")
    nodes = c.where("c_custkey % 3 <> 0").select(F.concat(F.when(k % 2 == 0, "character:").otherwise("stub:"), k.cast("string")).alias("graph_key"), F.when(k % 2 == 0, k).otherwise(0).alias("character_id"), F.col("c_name").alias("name"), none.alias("aliases"))
    wanted = c.select(k.alias("want_id"), F.when(k % 5 > 0, k).otherwise(0).alias("character_id"), F.col("c_name").alias("name"), none.alias("aliases"))
    found = graph.resolve_nodes(wanted, nodes).join(wanted.select("want_id", "character_id"), "want_id")
    return graph.stub_upgrades(found)


@query(f"WITH {INDEX}, n AS (SELECT count(*) AS n FROM books), w AS (SELECT DISTINCT item_id % n + 1 AS book_id, item_id % 40 - 3 AS chapter_index FROM benchmark, n) SELECT book_id, chapter_index, sha256(content) AS content_sha256 FROM ci SEMI JOIN w USING (book_id, chapter_index)")
def in_list_fetch(spark, sf_dir):
    """The chapters that lists of (book, chapter) ask for; every benchmark passage's number makes one entry, some of them no chapters."""
    books = tables.with_book(tables.table(spark, sf_dir, "documents", "source").distinct()).agg(F.count(F.lit(1))).scalar()
    wanted = tables.table(spark, sf_dir, "benchmark", "item_id").select((F.col("item_id") % books + 1).alias("book_id"), (F.col("item_id") % 40 - 3).alias("chapter_index"))
    found = jdbc.among(tables.contents(spark, sf_dir).select("book_id", "chapter_index", "content"), wanted, ["book_id", "chapter_index"])
    return found.select("book_id", "chapter_index", F.sha2("content", 256).alias("content_sha256"))
