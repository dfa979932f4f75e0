"""Queries over book sources, JSON, facts and streams."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from inkloom.functions import jsonx
from inkloom.operators import facts
from inkloom.operators.components import checkpointed
from inkloom.plans.base import INDEX, query
from inkloom.sources import books, tables
from inkloom.streaming import sessions


@query()
def html_text(spark, sf_dir):
    @F.pandas_udf("struct<text:string,headings:array<string>>")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([books.html_text(p) for p in pages], columns=["text", "headings"])

    rows = tables.table(spark, sf_dir, "pages", "page_id", "html").select("page_id", read("html").alias("r"))
    return rows.select("page_id", "r.text", F.array_join("r.headings", "\n").alias("headings"))


@query()
def chapter_slices(spark, sf_dir):
    found = books.sliced(tables.table(spark, sf_dir, "documents", "doc_id", "text"), id_col="doc_id")
    return found.select("doc_id", "chapter_index", "title", "word_count", F.sha2("content", 256).alias("content_sha256"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, [json_extract_string(props, '$.k')::BIGINT, 7][1] % 5 + 1 AS start, json_extract_string(props, '$.k')::BIGINT % 5 + 4 AS \"end\" FROM events")
def json_payloads(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "props")
    rows = rows.withColumn("p", jsonx.parsed(F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")), "struct<k:bigint>"))
    span = jsonx.chapter_range(F.concat((F.col("p.k") % 5 + 1).cast("string"), F.lit("-"), (F.col("p.k") % 5 + 4).cast("string")))
    return rows.select("event_id", F.col("p.k").alias("k"), span.alias("s")).select("event_id", "k", "s.start", "s.end")


@query("""SELECT doc_id, doc_id % 40 + 1 AS chapter, 'x ' || doc_id AS text FROM documents""")
def json_records(spark, sf_dir):
    n = F.col("doc_id").cast("string")
    raw = F.concat(F.lit("[[\""), (F.col("doc_id") % 40 + 1).cast("string"), F.lit("\", \" x "), n, F.lit(" \"], \"loose\", [\"no\", \"number\"], [3]]"))
    return tables.table(spark, sf_dir, "documents", "doc_id").select("doc_id", F.inline(jsonx.records(raw)))


@query(f"""WITH {INDEX} SELECT l AS entity_type, lower(src) AS name_key, min(src) AS name, min(chapter_index) AS first_chapter, max(chapter_index) AS last_chapter, min(plot_id) AS first_plot, max(plot_id) AS last_plot, bool_or(word_count % 2 = 0) AS is_core,
  row_number() OVER (ORDER BY l, lower(src)) AS entity_id FROM (SELECT ci.*, lang AS l, source AS src FROM ci JOIN documents USING (doc_id)) GROUP BY l, lower(src)""")
def entity_registry(spark, sf_dir):
    docs = tables.table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    core = tables.word_counts(spark, sf_dir).select("doc_id", (F.col("word_count") % 2 == 0).alias("is_core"))
    rows = tables.chapter_index(spark, sf_dir).join(docs, "doc_id").join(core, "doc_id")
    return facts.with_ids(facts.registry(rows.select(F.col("lang").alias("entity_type"), F.col("source").alias("name"), "chapter_index", "plot_id", "is_core")))


@query("""SELECT l_suppkey AS chapter_index, l_returnflag AS name, bool_or(l_linenumber = 1) AS in_core, bool_or(l_linenumber = 2) AS in_present, bool_or(l_linenumber = 3) AS in_mentioned, bool_or(l_linenumber > 3) AS in_hidden FROM lineitem GROUP BY 1, 2""")
def chapter_mentions(spark, sf_dir):
    n = F.col("l_linenumber")
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linenumber")
    flag = F.when(n == 1, "core").when(n == 2, "present").when(n == 3, "mentioned").otherwise("hidden")
    return facts.mentions(rows.select(F.col("l_suppkey").alias("chapter_index"), F.col("l_returnflag").alias("name"), flag.alias("flag")))


@query(r"""WITH d AS (SELECT doc_id, source, list_distinct(regexp_extract_all(coalesce(text, ''), '\p{Lu}\p{Ll}{3,}')) AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS w FROM d), k AS (SELECT doc_id, w, lower(w) AS k, length(w) AS n FROM w),
m AS (SELECT doc_id, 'character' AS entity_type, k AS name_key, 1 AS is_mentioned, (n % 2 = 0)::INT AS is_active, (n % 3 = 0)::INT AS is_dialogue_speaker, (n > 9)::INT AS is_focus_candidate, NULL AS a FROM k
  UNION ALL SELECT doc_id, 'character', k, 0, 0, 0, 0, w || 'x' FROM k WHERE n % 5 = 0 UNION ALL SELECT doc_id, 'character', k || 'y', 0, 0, 0, 0, w || 'y' FROM k WHERE n = 7 UNION ALL SELECT doc_id, 'faction', lower(source), 1, 0, 0, 0, NULL FROM d WHERE source IS NOT NULL)
SELECT doc_id, entity_type, name_key, max(is_mentioned) AS is_mentioned, max(is_active) AS is_active, max(is_dialogue_speaker) AS is_dialogue_speaker, max(is_focus_candidate) AS is_focus_candidate, coalesce(array_to_string(list_sort(list_distinct(list(a) FILTER (WHERE a IS NOT NULL))), '/'), '') AS aliases FROM m GROUP BY 1, 2, 3""")
def index_mentions(spark, sf_dir):
    """Every document's index as JSON: its capitalised words as characters in lists by their length, some with another name as an object, some as a bare one, and its source as a faction in a deeper place."""
    docs = tables.table(spark, sf_dir, "documents", "doc_id", "text", "source")
    of = lambda test: F.filter("w", lambda x: test(F.length(x)))
    named = F.transform(of(lambda n: n % 5 == 0), lambda x: F.to_json(F.struct(F.lit("  ").alias("standard_name"), F.concat(F.lit("<"), x, F.lit(">")).alias("name"), F.concat(x, F.lit("x - y")).alias("appellation"), F.lit("nick").alias("kind"))))
    bare = F.transform(of(lambda n: n == 7), lambda x: F.to_json(F.struct(F.concat(x, F.lit("y")).alias("v"))))
    bare = F.transform(bare, lambda x: F.regexp_extract(x, r'^\{"v":(.*)\}$', 1))
    inner = lambda **lists: F.regexp_replace(F.to_json(F.struct(*[c.alias(k) for k, c in lists.items()])), r"\}$", "")
    characters = F.concat(inner(mentioned_characters=F.col("w"), active_characters=of(lambda n: n % 2 == 0), key_dialogue_speakers=of(lambda n: n % 3 == 0), candidate_focus_characters=of(lambda n: n > 9)), F.lit(', "aliases_or_appellations": ['), F.array_join(F.concat(named, bare), ", "), F.lit("]}"))
    factions = F.to_json(F.struct(F.struct(F.array_compact(F.array("source")).alias("mentioned_factions"), F.lit("no list").alias("active_factions")).alias("faction_index")))
    rows = docs.withColumn("w", F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"\p{Lu}\p{Ll}{3,}"), F.lit(0))))
    rows = rows.select("doc_id", F.concat(F.lit('{"character_index": '), characters, F.lit(', "entity_index": '), factions, F.lit("}")).alias("payload"))
    found = facts.index_mentions(rows, "doc_id", "payload")
    return found.select("doc_id", "entity_type", "name_key", *facts.FLAGS, F.array_join(F.array_sort("source_aliases"), "/").alias("aliases"))


@query("""SELECT p_partkey, 'brand' AS kind, 0 AS place, p_brand AS fact FROM part UNION ALL SELECT p_partkey, 'words', generate_subscripts(string_split(p_type, ' '), 1) - 1, unnest(string_split(p_type, ' ')) FROM part""")
def fact_unpivot(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    rows = rows.select("p_partkey", F.array("p_brand").alias("brand"), F.split("p_type", " ").alias("words"))
    return facts.unpivoted(rows, "p_partkey", ["brand", "words"])


def _streamed(spark, sf_dir, make, mode):
    """Runs a stream of the events over all that is there, into the shared folder, and reads the result."""
    root = checkpoint_root(spark)
    sessions.run_once(make(sessions.read(spark, sf_dir)), f"{root}/out", f"{root}/state", mode)
    return spark.read.parquet(f"{root}/out")


def checkpoint_root(spark) -> str:
    checkpointed(spark.range(1))  # makes sure of the shared folder
    return f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM g)
SELECT user_id, count(*) AS n, epoch_us(min(ts))::BIGINT AS started_us, epoch_us(max(ts))::BIGINT AS ended_us FROM s GROUP BY user_id, s.n""")
def session_gaps(spark, sf_dir):
    events = tables.table(spark, sf_dir, "events", "user_id", "ts", "value").withColumn("ts", F.col("ts").cast("timestamp"))
    found = events.groupBy("user_id", F.session_window("ts", "10 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("z"))
    return found.select("user_id", "n", F.unix_micros("a").alias("started_us"), F.unix_micros("z").alias("ended_us"))


@query("SELECT user_id, max(event_id) FILTER (WHERE k % 11 = 0) AS upto, count(*) // 11 AS fired FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events) GROUP BY user_id HAVING count(*) >= 11")
def stream_summary_due(spark, sf_dir):
    found = _streamed(spark, sf_dir, sessions.due, "append")
    return found.groupBy("user_id").agg(F.max("upto").alias("upto"), F.count(F.lit(1)).alias("fired"))
