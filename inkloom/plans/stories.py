"""Queries over relations, entities, retrieval, evidence, graph, writes, sessions and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import keys, text
from inkloom.operators import dataset, entities, entries, evidence, graph, profiles, ranks, relations, retrieval, search, sessions, sync
from inkloom.operators.components import written
from inkloom.plans.base import CHAPTERS, EVENTS, INDEX, MESSAGES, query
from inkloom.sources import tables

# --- relations

_ISLANDS = f"""{EVENTS}, o AS (SELECT *, row_number() OVER w AS n, CASE WHEN lag(relation_type) OVER w = relation_type AND lag(polarity) OVER w = polarity AND lag(strength) OVER w = strength THEN 0 ELSE 1 END AS other
    FROM rel WINDOW w AS (PARTITION BY source_id, target_id ORDER BY chapter_start, chapter_end, relation_type, polarity, strength, summary)),
r AS (SELECT *, sum(other) OVER (PARTITION BY source_id, target_id ORDER BY n) AS run FROM o),
m AS (SELECT *, max(chapter_end) OVER (PARTITION BY source_id, target_id, run ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM r),
i AS (SELECT *, sum(CASE WHEN chapter_start <= reached + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY source_id, target_id ORDER BY n) AS island FROM m),
islands AS (SELECT source_id, target_id, island, any_value(relation_type) AS relation_type, any_value(polarity) AS polarity, any_value(strength) AS strength, min(chapter_start) AS chapter_start, max(chapter_end) AS chapter_end,
    count(*) AS n_events, arg_min(summary, n) AS first_summary FROM i GROUP BY source_id, target_id, island)"""


def _islands(spark, sf_dir):
    return relations.islands(tables.relation_events(spark, sf_dir), ["source_id", "target_id"])


@query(f"WITH {_ISLANDS} SELECT * REPLACE (island::BIGINT AS island) FROM islands")
def relation_islands(spark, sf_dir):
    return _islands(spark, sf_dir)


@query(f"""WITH {_ISLANDS} SELECT source_id, target_id, sha256(string_agg(chapter_start || '-' || chapter_end || ' ' || relation_type || ' ' || polarity || ' ' || strength, '; ' ORDER BY island)) AS history_sha256
FROM islands GROUP BY source_id, target_id""")
def edge_history(spark, sf_dir):
    return graph.history(_islands(spark, sf_dir)).select("source_id", "target_id", F.sha2("history", 256).alias("history_sha256"))


@query("""WITH e AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey END AS target_id, CASE WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS target_name, month(o_orderdate)::BIGINT AS a FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT lower(target_name) AS name_key, coalesce(arg_min(target_id, CASE WHEN target_id > 0 THEN ord END), 0)::BIGINT AS target_id,
  coalesce(arg_min(target_name, CASE WHEN target_id > 0 THEN ord END), arg_min(target_name, ord)) AS target_name, min(a) AS chapter_start, max(a) AS chapter_end, count(*) AS n_events FROM e GROUP BY 1""")
def relation_group(spark, sf_dir):
    o, c = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate"), tables.table(spark, sf_dir, "customer", "c_custkey", "c_name")
    month = F.month("o_orderdate").cast("bigint")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 3 == 0, 0).otherwise(F.col("o_custkey")).alias("target_id"), F.when(F.col("o_orderkey") % 2 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("target_name"), month.alias("chapter_start"), month.alias("chapter_end"))
    return relations.grouped(rows)


@query(f"""WITH {EVENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY chapter_start, chapter_end, relation_type, polarity, strength, summary) AS ord FROM rel)
SELECT source_id, target_id, arg_min(relation_type, ord) AS relation_type, arg_min(polarity, CASE WHEN polarity <> '' THEN ord END) AS polarity, arg_min(strength, ord) AS strength,
  count(DISTINCT chapter_start) AS chapters, min(chapter_start) AS chapter_start, max(chapter_end) AS chapter_end FROM r GROUP BY source_id, target_id""")
def relation_rows(spark, sf_dir):
    order = F.struct("chapter_start", "chapter_end", "relation_type", "polarity", "strength", "summary")
    found = relations.deduped(tables.relation_events(spark, sf_dir).withColumn("ord", order))
    return found.withColumn("chapters", F.size("chapters").cast("bigint"))


@query(f"""WITH {_ISLANDS}, rw AS (SELECT s_nationkey::BIGINT AS source_id, lower(n_name) AS name_key, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_orderkey % 3 = 0 THEN n_nationkey ELSE 0 END::BIGINT AS target_id, CASE WHEN l_orderkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS target_name,
    CASE WHEN l_linenumber = 1 THEN 's' || (l_orderkey % 5) ELSE '' END AS summary, ['t' || l_suppkey % 7, ' t' || l_linenumber || ' ', ''] AS acts, CASE WHEN l_quantity > 25 THEN [l_returnflag, l_linestatus] END AS moods, CASE WHEN l_orderkey % 4 = 0 THEN ' d' || l_linenumber ELSE ' ' END AS stability
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON c_nationkey = n_nationkey),
el AS (SELECT source_id, name_key, ord, 'summary' AS list, trim(summary) AS e, 0 AS i FROM rw UNION ALL SELECT source_id, name_key, ord, 'acts', trim(unnest(acts)), generate_subscripts(acts, 1) FROM rw UNION ALL SELECT source_id, name_key, ord, 'moods', trim(unnest(moods)), generate_subscripts(moods, 1) FROM rw),
on_ AS (SELECT source_id, name_key, list, e, min(ord * 10 + i) AS place FROM el WHERE e <> '' GROUP BY ALL), li AS (SELECT source_id, name_key, string_agg(e, '；' ORDER BY place, e) FILTER (WHERE list = 'summary') AS summary, string_agg(e, '/' ORDER BY place, e) FILTER (WHERE list = 'acts') AS acts, string_agg(e, '/' ORDER BY place, e) FILTER (WHERE list = 'moods') AS moods FROM on_ GROUP BY ALL),
he AS (SELECT source_id, name_key, coalesce(arg_min(target_id, CASE WHEN target_id > 0 THEN ord END), 0) AS target_id, coalesce(arg_min(target_name, CASE WHEN target_id > 0 THEN ord END), arg_min(target_name, ord)) AS target_name, coalesce(arg_min(trim(stability), CASE WHEN trim(stability) <> '' THEN ord END), '') AS stability FROM rw GROUP BY ALL),
hi AS (SELECT source_id, lower(n_name) AS name_key, min(chapter_start) AS first_chapter, max(chapter_end) AS last_chapter, sha256(string_agg(chapter_start || '-' || chapter_end || relation_type || polarity || strength || first_summary, ';' ORDER BY island)) AS history_sha256 FROM islands JOIN nation ON n_nationkey = target_id GROUP BY ALL)
SELECT he.*, coalesce(summary, '') AS summary, coalesce(acts, '') AS acts, coalesce(moods, '') AS moods, first_chapter, last_chapter, history_sha256 FROM he LEFT JOIN li USING (source_id, name_key) LEFT JOIN hi USING (source_id, name_key)""")
def stored_relations(spark, sf_dir):
    """Every line of an order as a row of a relation between nations, with overlapping histories, as the rows are stored."""
    li = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    o, c, s, n = (tables.table(spark, sf_dir, *t) for t in (("orders", "o_orderkey", "o_custkey"), ("customer", "c_custkey", "c_nationkey"), ("supplier", "s_suppkey", "s_nationkey"), ("nation", "n_nationkey", "n_name")))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k, line, text = F.col("l_orderkey"), F.col("l_linenumber"), lambda x: x.cast("string")
    month = ((F.year("l_shipdate") - 1992) * 12 + F.month("l_shipdate")).cast("bigint")
    event = F.struct(
        month.alias("chapter_start"), (month + line % 2).cast("bigint").alias("chapter_end"), F.col("l_linestatus").alias("relation_type"), F.when(F.col("l_returnflag") == "R", "negative").when(F.col("l_returnflag") == "A", "positive").otherwise("neutral").alias("polarity"),
        F.when(F.col("l_quantity") > 33, "high").when(F.col("l_quantity") > 16, "medium").otherwise("low").alias("strength"), F.concat(F.lit("order "), text(k)).alias("summary"),
    )
    rows = rows.select(
        F.col("s_nationkey").cast("bigint").alias("source_id"), (k * 10 + line).alias("ord"), F.when(k % 3 == 0, F.col("n_nationkey")).otherwise(0).cast("bigint").alias("target_id"), F.when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("target_name"),
        F.when(line == 1, F.concat(F.lit("s"), text(k % 5))).otherwise("").alias("summary"), F.array(F.concat(F.lit("t"), text(F.col("l_suppkey") % 7)), F.concat(F.lit(" t"), text(line), F.lit(" ")), F.lit("")).alias("acts"),
        F.when(F.col("l_quantity") > 25, F.array("l_returnflag", "l_linestatus")).alias("moods"), F.when(k % 4 == 0, F.concat(F.lit(" d"), text(line))).otherwise(" ").alias("stability"), F.array(event).alias("history"),
    )
    found = relations.stored_rows(rows, ["acts", "moods"], ["stability"])
    line = lambda h: F.concat(text(h["chapter_start"]), F.lit("-"), text(h["chapter_end"]), h["relation_type"], h["polarity"], h["strength"], h["summary"])
    return found.withColumn("history_sha256", F.sha2(F.array_join(F.transform("history", line), ";"), 256)).withColumns({c: F.array_join(c, "/") for c in ("acts", "moods")}).drop("history")


@query("""SELECT o_custkey, sum(CASE WHEN o_totalprice > 300000 THEN 3 WHEN o_totalprice > 150000 THEN 2 ELSE 1 END + CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 1 END)::BIGINT AS score, count(*) AS n,
  min(year(o_orderdate))::BIGINT AS chapter_start, max(year(o_orderdate))::BIGINT AS chapter_end FROM orders GROUP BY o_custkey HAVING score >= 3""")
def emotion_score(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderpriority", "o_orderdate")
    year = F.year("o_orderdate").cast("bigint")
    rows = rows.select("o_custkey", F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 150000, "medium").otherwise("low").alias("intensity"), F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("high").alias("confidence"), year.alias("chapter_start"), year.alias("chapter_end"))
    return relations.emotion_scores(rows, ["o_custkey"])


@query("""WITH w AS (SELECT doc_id * 1000000 + pos AS ord, w AS signal FROM (SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS w, generate_subscripts(string_split_regex(text, '\\s+'), 1) AS pos FROM documents))
SELECT arg_min(signal, ord) AS signal, count(*) AS occurrences FROM w WHERE signal <> '' GROUP BY lower(signal)""")
def style_counts(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "signal"))
    return relations.style_counts(rows.select((F.col("doc_id") * 1000000 + F.col("pos") + 1).alias("ord"), "signal"))


@query(r"""WITH q AS (SELECT conv_id * 1000 + turn AS ord, trim(role) AS scene, trim(split_part(regexp_replace(text, '\s+', ' ', 'g'), '.', 1)) AS quote FROM conversations)
SELECT arg_min(scene, ord) AS scene, arg_min(quote, ord) AS quote, count(*) AS occurrences FROM q WHERE scene <> '' AND quote <> '' GROUP BY lower(regexp_replace(scene || '|' || quote, '\s+', '', 'g')) ORDER BY occurrences DESC, scene, quote LIMIT 30""")
def style_scenes(spark, sf_dir):
    """The most frequent first sentences of each role."""
    rows = tables.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return relations.style_scenes(rows.select(F.col("role").alias("scene"), F.substring_index(F.regexp_replace("text", r"(?U)\s+", " "), ".", 1).alias("quote"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord")))


@query("""WITH s AS (SELECT o_orderkey AS segment_id, o_custkey AS k, (o_orderkey % 50)::BIGINT AS a, (o_orderkey % 50 + o_orderkey % 4)::BIGINT AS z FROM orders),
g AS (SELECT l_orderkey * 10 + l_linenumber AS group_id, o_custkey AS k, (l_partkey % 60)::BIGINT AS a, (l_partkey % 60 + l_linenumber)::BIGINT AS z FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
m AS (SELECT segment_id, group_id FROM s JOIN g ON s.k = g.k AND s.a <= g.z AND g.a <= s.z), last AS (SELECT k, arg_max(group_id, (a, group_id)) AS group_id FROM g GROUP BY k)
SELECT * FROM m UNION ALL SELECT segment_id, last.group_id FROM s JOIN last USING (k) WHERE segment_id NOT IN (SELECT segment_id FROM m)""")
def segment_overlap(spark, sf_dir):
    o, li = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    segments = o.select(F.col("o_orderkey").alias("segment_id"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 50).alias("start"), (F.col("o_orderkey") % 50 + F.col("o_orderkey") % 4).alias("end"))
    groups = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("group_id"), F.col("o_custkey").alias("k"), (F.col("l_partkey") % 60).alias("start"), (F.col("l_partkey") % 60 + F.col("l_linenumber")).alias("end"))
    return relations.overlapping(segments, groups, "k")


# --- entities

_ITEMS = "items AS (SELECT p_partkey AS item_id, p_name AS name, [p_brand || (p_partkey % 97), p_type || (p_partkey % 89)] AS aliases FROM part)"


def _items(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    first = F.concat("p_brand", (F.col("p_partkey") % 97).cast("string"))
    return rows.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("name"), F.array(first, F.concat("p_type", (F.col("p_partkey") % 89).cast("string"))).alias("aliases"))


@query(f"""WITH RECURSIVE {_ITEMS}, pairs AS (SELECT DISTINCT item_id, unnest(aliases) AS alias FROM items), edges AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM pairs a JOIN pairs b USING (alias)),
reach(item_id, r) AS (SELECT item_id, item_id FROM items UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.item_id AND reach.r < e.b)
SELECT item_id, min(r) AS component FROM reach GROUP BY item_id""")
def alias_components(spark, sf_dir):
    return entities.alias_components(_items(spark, sf_dir))


@query(f"""WITH RECURSIVE {_ITEMS}, pairs AS (SELECT DISTINCT item_id, unnest(aliases) AS alias FROM items), edges AS (SELECT DISTINCT a.item_id AS a, b.item_id AS b FROM pairs a JOIN pairs b USING (alias)),
reach(item_id, r) AS (SELECT item_id, item_id FROM items UNION SELECT e.b, reach.r FROM reach JOIN edges e ON e.a = reach.item_id AND reach.r < e.b), comp AS (SELECT item_id, min(r) AS component FROM reach GROUP BY item_id),
al AS (SELECT component, alias, min(item_id * 10 + pos) AS place FROM (SELECT item_id, unnest(aliases) AS alias, generate_subscripts(aliases, 1) AS pos FROM items) JOIN comp USING (item_id) GROUP BY component, alias)
SELECT component, (SELECT name FROM items WHERE item_id = component) AS name, (SELECT count(*) FROM comp c WHERE c.component = al.component) AS n_items, sha256(string_agg(alias, '/' ORDER BY place, e)) AS aliases_sha256 FROM al GROUP BY component""")
def alias_merge(spark, sf_dir):
    items = _items(spark, sf_dir)
    found = entities.merged(items, entities.alias_components(items))
    return found.select("component", "name", "n_items", F.sha2(F.array_join("aliases", "/"), 256).alias("aliases_sha256"))


@query("SELECT lower(p_brand || p_type) AS name_key, arg_min(CASE WHEN p_partkey % 2 = 0 THEN upper(p_brand) || ' ' || p_type ELSE p_brand || p_type END, p_partkey) AS name, count(*) AS n_rows, min(p_partkey) AS first_id FROM part GROUP BY 1")
def fold_names(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type")
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" ", F.upper("p_brand"), "p_type")).otherwise(F.concat("p_brand", "p_type"))
    found = entities.folded_names(rows.select(F.col("p_partkey").alias("item_id"), name.alias("name")))
    return found.select("name_key", "name", "n_rows", "first_id")


@query("""WITH claims AS (SELECT DISTINCT c_name AS name, lower(a) AS k FROM (SELECT c_name, unnest([c_name, c_mktsegment || (c_custkey % 700)]) AS a FROM customer)), sole AS (SELECT k, min(name) AS name FROM claims GROUP BY k HAVING count(*) = 1)
SELECT o_orderkey AS mention_id, name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN upper(c_name) ELSE c_mktsegment || (o_orderkey % 1000) END AS mention FROM orders JOIN customer ON o_custkey = c_custkey) LEFT JOIN sole ON lower(mention) = k""")
def alias_resolution(spark, sf_dir):
    c, o = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment"), tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    known = c.select(F.col("c_name").alias("name"), F.array(F.concat("c_mktsegment", (F.col("c_custkey") % 700).cast("string"))).alias("aliases"))
    mention = F.when(F.col("o_orderkey") % 3 == 0, F.upper("c_name")).otherwise(F.concat("c_mktsegment", (F.col("o_orderkey") % 1000).cast("string")))
    return entities.resolved(o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("mention_id"), mention.alias("mention")), known)


@query("SELECT l_suppkey AS group_id, l_linestatus || l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n DESC, min(l_linenumber), length(name) DESC, name) = 1")
def canonical_name(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_linestatus", "l_returnflag", "l_linenumber")
    return entities.canonical_names(rows.select(F.col("l_suppkey").alias("group_id"), F.concat("l_linestatus", "l_returnflag").alias("name"), F.col("l_linenumber").alias("rank")))


@query("SELECT l_suppkey AS group_id, l_returnflag AS name, count(*) AS occurrences, count(*) FILTER (WHERE l_linestatus = 'O') AS as_name, count(*) FILTER (WHERE l_linestatus = 'F') AS as_alias, count(DISTINCT l_partkey) AS items FROM lineitem GROUP BY 1, 2")
def candidate_stats(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_returnflag", "l_linestatus", "l_partkey")
    return entities.candidate_stats(rows.select(F.col("l_suppkey").alias("group_id"), F.col("l_returnflag").alias("name"), F.when(F.col("l_linestatus") == "O", "name").otherwise("alias").alias("role"), F.col("l_partkey").alias("item_id")))


@query("""SELECT l_suppkey AS character_id, count(*) AS record_count, min(l_partkey) AS first_chapter, max(l_partkey) AS last_chapter, array_to_string(list_sort(list_distinct(list(l_returnflag || l_linestatus)))[1:3], '/') AS preview
FROM lineitem GROUP BY 1 HAVING count(*) > 20 ORDER BY record_count DESC, character_id""")
def character_cards(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus")
    found = entities.cards(rows.select(F.col("l_suppkey").alias("character_id"), F.col("l_partkey").alias("chapter_index"), F.concat("l_returnflag", "l_linestatus").alias("alias")))
    return found.where("record_count > 20").orderBy(F.desc("record_count"), "character_id")


@query("SELECT r AS root, count(DISTINCT p_name) AS n FROM part, (VALUES ('rod'), ('plate'), ('ring'), ('zz')) t(r) WHERE right(p_name, length(r)) = r GROUP BY r HAVING n >= 2")
def candidate_groups(spark, sf_dir):
    return entities.shared_root_groups(tables.table(spark, sf_dir, "part", "p_name").withColumnRenamed("p_name", "name"), ["rod", "plate", "ring", "zz"])


# --- retrieval

_DENSE = """q AS (SELECT label::BIGINT AS query_id, label AS book_id, embedding AS v FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
d AS (SELECT query_id, vec_id AS id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 9) DESC, vec_id) AS rank, round(list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[]), 6) AS score FROM embeddings JOIN q ON label = book_id QUALIFY rank <= 75)"""


def _dense(spark, sf_dir, most=75):
    rows = tables.table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    first = rows.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("vector")).select(F.col("label").cast("bigint").alias("query_id"), F.col("label").alias("book_id"), "vector")
    return retrieval.dense(first, rows.select(F.col("vec_id").alias("id"), F.col("label").alias("book_id"), F.col("embedding").alias("vector")), most)


@query(f"WITH {_DENSE} SELECT query_id, id, rank, score + 0.0 AS score FROM d")
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "id", F.col("rank").cast("bigint").alias("rank"), (F.round("score", 6) + 0.0).alias("score"))


_SPARSE = """b AS (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9_]+')) AS qt FROM benchmark),
qt AS (SELECT query_id, len(qt) AS n, unnest(qt) AS t FROM b), dt AS (SELECT doc_id AS id, unnest(list_distinct(regexp_extract_all(lower(text), '[一-鿿]+|[a-z0-9_]+'))) AS t FROM documents),
o AS (SELECT query_id, id, round(count(*) / any_value(n), 6) AS sparse_score FROM dt JOIN qt USING (t) GROUP BY query_id, id),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sparse_score DESC, id) AS sparse_rank FROM o QUALIFY sparse_rank <= 25)"""


def _sparse(spark, sf_dir):
    """Every benchmark passage as a question to all documents; written, as most queries use it more than once."""

    def make():
        q = tables.table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
        return written(retrieval.overlap_topk(q, tables.table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "id"), 25))

    return tables.once("sparse", sf_dir, make)


@query(f"WITH {_SPARSE} SELECT * FROM s")
def sparse_overlap(spark, sf_dir):
    return _sparse(spark, sf_dir).select("query_id", "id", F.round("sparse_score", 6).alias("sparse_score"), F.col("sparse_rank").cast("bigint").alias("sparse_rank"))


_FUSED = f"""{_DENSE}, {_SPARSE}, fu AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, round(coalesce(1 / (60 + rank), 0) + coalesce(1 / (60 + sparse_rank), 0), 9) AS fused_score FROM d FULL JOIN s ON d.query_id = s.query_id AND d.id = s.id),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused_score DESC, id) AS fused_rank FROM fu QUALIFY fused_rank <= 25)"""


@query(f"WITH {_FUSED} SELECT * FROM f")
def rrf_fusion(spark, sf_dir):
    found = retrieval.fused(_dense(spark, sf_dir), _sparse(spark, sf_dir), 25)
    return found.select("query_id", "id", F.round("fused_score", 9).alias("fused_score"), F.col("fused_rank").cast("bigint").alias("fused_rank"))


@query(f"""WITH {_FUSED} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN fused_rank <= 7 THEN id * 7 % 17 END DESC NULLS LAST, fused_rank) AS final_rank FROM f QUALIFY final_rank <= 10""")
def rerank_pad(spark, sf_dir):
    found = retrieval.fused(_dense(spark, sf_dir), _sparse(spark, sf_dir), 25)
    scores = found.where("fused_rank <= 7").select("query_id", "id", (F.col("id") * 7 % 17).alias("rerank_score"))  # the reranker answers for the first seven only; the rest pads
    return retrieval.reranked(found, scores, 10).withColumn("final_rank", F.col("final_rank").cast("bigint"))


@query(f"""WITH {_DENSE}, fl AS (SELECT query_id, id FROM d WHERE query_id % 2 = 0 AND id % 5 = 0) SELECT * FROM fl UNION ALL SELECT query_id, id FROM d WHERE query_id NOT IN (SELECT query_id FROM fl)""")
def source_filter_retry(spark, sf_dir):
    found = _dense(spark, sf_dir).select("query_id", "id")
    return retrieval.with_retry(found.where("query_id % 2 = 0 AND id % 5 = 0"), found)


@query("""WITH v AS (SELECT o_custkey AS id, l_partkey AS i, sum(l_linenumber)::BIGINT AS x FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
SELECT a.id AS left_id, b.id AS right_id, sum(a.x * b.x)::BIGINT AS dot FROM v a JOIN v b USING (i) WHERE a.id % 20 = 0 GROUP BY 1, 2""")
def sparse_dot(spark, sf_dir):
    """Customers as sparse vectors over parts: every twentieth is a question to all."""
    li, o = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber"), tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    lines = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("l_partkey").alias("index"), F.col("l_linenumber").alias("_v"))
    rows = written(retrieval.summed(lines, ["id", "index"], "_v", "value", li.count()))  # both sides and their counts are made of it
    return retrieval.sparse_dot(rows.where("id % 20 = 0"), rows)


@query("""WITH w AS (SELECT vec_id AS id, 'h' || (label % 4) AS hash FROM embeddings WHERE vec_id % 9 <> 0), s AS (SELECT vec_id AS id, 'h' || (label % 3) AS hash FROM embeddings WHERE vec_id % 7 <> 0)
SELECT coalesce(w.id, s.id) AS id, CASE WHEN w.id IS NULL THEN 'delete' WHEN s.id IS NULL THEN 'insert' WHEN w.hash = s.hash THEN 'skip' ELSE 'update' END AS action FROM w FULL JOIN s ON w.id = s.id""")
def vector_sync_plan(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "embeddings", "vec_id", "label")
    of = lambda m, k: rows.where(F.col("vec_id") % k != 0).select(F.col("vec_id").alias("id"), F.concat(F.lit("h"), (F.col("label") % m).cast("string")).alias("hash"))
    return retrieval.sync_plan(of(4, 9), of(3, 7))


# --- evidence

_EV = f"""{INDEX}, ev AS (SELECT book_id, CASE WHEN word_count % 4 = 0 THEN 'chapters' WHEN word_count % 4 = 1 THEN 'plots' WHEN word_count % 4 = 2 THEN 'volumes' ELSE 'characters' END AS source,
    CASE WHEN word_count % 4 = 0 THEN chapter_index END AS chapter_index, CASE WHEN word_count % 4 = 1 THEN plot_id END AS plot_id, CASE WHEN word_count % 4 = 2 THEN volume_id END AS volume_id,
    chapter_index AS rank, 'sq' || (word_count % 3) AS subquery_id FROM ci)"""


def _evidence(spark, sf_dir):
    n = F.col("word_count") % 4
    rows = tables.with_hierarchy(tables.word_counts(spark, sf_dir).select("book_id", "chapter_index", "word_count"))
    source = F.when(n == 0, "chapters").when(n == 1, "plots").when(n == 2, "volumes").otherwise("characters")
    return rows.select("book_id", source.alias("source"), F.when(n == 0, F.col("chapter_index")).alias("chapter_index"), F.when(n == 1, F.col("plot_id")).alias("plot_id"), F.when(n == 2, F.col("volume_id")).alias("volume_id"), F.col("chapter_index").alias("rank"), F.concat(F.lit("sq"), (F.col("word_count") % 3).cast("string")).alias("subquery_id"))


_SCORED = _EV + ", sv AS (SELECT *, 1 / rank * CASE source WHEN 'chapters' THEN 1.0 WHEN 'plots' THEN 0.72 WHEN 'volumes' THEN 0.55 ELSE 0.65 END::DOUBLE AS score FROM ev)"


def _scored(spark, sf_dir):
    return _evidence(spark, sf_dir).withColumn("score", evidence.evidence_score(F.col("source"), F.col("rank")))


_POOL = f"""{_SCORED}, places AS (SELECT book_id, chapter_index AS at, plot_id AS p, split_part(chapter_summary, ' ', 1) AS source_name, chapter_summary AS snippet FROM ci),
pool AS (SELECT sv.*, source_name, snippet, CASE WHEN sv.plot_id IS NOT NULL THEN (p - 1) * 5 + 1 END AS start_chapter, CASE WHEN sv.plot_id IS NOT NULL THEN p * 5 END AS end_chapter FROM sv JOIN places ON sv.book_id = places.book_id AND sv.rank = places.at),
parts AS (SELECT * REPLACE (rank * 2 AS rank) FROM pool UNION ALL SELECT * REPLACE (rank * 2 + 1 AS rank, score * 1.1 AS score, 'sq' || (rank % 4) AS subquery_id, snippet || ' again' AS snippet) FROM pool WHERE length(snippet) > 120 UNION ALL SELECT * REPLACE (rank * 2 + 1 AS rank, 'sq9' AS subquery_id) FROM pool WHERE rank % 2 = 0)"""
_PLACES = ["chapter_index", "plot_id", "volume_id", "start_chapter", "end_chapter"]


@query(f"""WITH {_POOL}, m AS (SELECT book_id, source, chapter_index, plot_id, volume_id, start_chapter, end_chapter, source_name, left(snippet, 120) AS st, max(score) AS score, arg_max(snippet, (score, -rank)) AS snippet, array_to_string(list_sort(list_distinct(list(subquery_id))), ',') AS subquery_ids, count(*) AS n, min(rank) AS first_rank
  FROM parts GROUP BY ALL) SELECT book_id, source, coalesce(chapter_index, 0) AS chapter_index, coalesce(plot_id, 0) AS plot_id, coalesce(volume_id, 0) AS volume_id, coalesce(start_chapter, 0) AS start_chapter, coalesce(end_chapter, 0) AS end_chapter, source_name, sha256(snippet) AS snippet_sha256, round(score, 9) AS score, subquery_ids, n,
  row_number() OVER (PARTITION BY book_id ORDER BY score DESC, first_rank, st) AS nth FROM m""")
def evidence_merge(spark, sf_dir):
    """Two passes over every book's evidence as one pool: the second finds long pieces again with a higher score and a longer text, a third finds every other piece again."""
    summaries = tables.with_hierarchy(tables.cards(spark, sf_dir).select("book_id", "chapter_index", "chapter_summary"))
    places = summaries.select(F.col("book_id").alias("_b"), F.col("chapter_index").alias("_c"), F.col("plot_id").alias("_p"), F.substring_index("chapter_summary", " ", 1).alias("source_name"), F.col("chapter_summary").alias("snippet"))
    pool = _scored(spark, sf_dir).join(places, (F.col("book_id") == F.col("_b")) & (F.col("rank") == F.col("_c")))
    ranged = lambda c: F.when(F.col("plot_id").isNotNull(), c)
    pool = pool.withColumns({"start_chapter": ranged((F.col("_p") - 1) * 5 + 1), "end_chapter": ranged(F.col("_p") * 5)}).drop("_b", "_c", "_p")
    later = (F.col("rank") * 2 + 1).alias("ord")
    keep = [c for c in pool.columns if c not in ("score", "subquery_id", "snippet")]
    first = pool.select(*keep, "snippet", "score", "subquery_id", (F.col("rank") * 2).alias("ord"))
    second = pool.where(F.length("snippet") > 120).select(*keep, F.concat("snippet", F.lit(" again")).alias("snippet"), (F.col("score") * 1.1).alias("score"), F.concat(F.lit("sq"), (F.col("rank") % 4).cast("string")).alias("subquery_id"), later)
    third = pool.where("rank % 2 = 0").select(*keep, "snippet", "score", F.lit("sq9").alias("subquery_id"), later)
    found = evidence.merged(first.unionByName(second).unionByName(third), ["book_id"])
    return found.select("book_id", "source", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in _PLACES], "source_name", F.sha2("snippet", 256).alias("snippet_sha256"), F.round("score", 9).alias("score"), "subquery_ids", "n", "nth")


_CLUSTERS = f"""{CHAPTERS}, {_SPARSE}, sc AS (SELECT query_id, book_id, chapter_index, (sparse_score * 1000000)::BIGINT AS score FROM s JOIN chapters ON doc_id = id),
l AS (SELECT *, CASE WHEN chapter_index - lag(chapter_index) OVER (PARTITION BY query_id, book_id ORDER BY chapter_index) <= 2 THEN 0 ELSE 1 END AS new FROM sc),
c AS (SELECT *, sum(new) OVER (PARTITION BY query_id, book_id ORDER BY chapter_index) AS c FROM l), cl AS (SELECT query_id, book_id, min(chapter_index) AS "start", max(chapter_index) AS "end", count(*) AS chapters, sum(score)::BIGINT AS score FROM c GROUP BY query_id, book_id, c)"""
_BY = ["query_id", "book_id"]


def _found(spark, sf_dir):
    """The chapters that each question finds, with their scores in millionths."""
    hits = _sparse(spark, sf_dir).select("query_id", "id", F.round(F.round("sparse_score", 6) * 1000000).cast("bigint").alias("score"))
    places = tables.chapter_index(spark, sf_dir).select("doc_id", "book_id", "chapter_index")
    return hits.join(places, F.col("id") == F.col("doc_id")).select(*_BY, "chapter_index", "score")


@query(f"WITH {_CLUSTERS} SELECT * FROM cl")
def chapter_clusters(spark, sf_dir):
    return evidence.clusters(_found(spark, sf_dir), keys=_BY)


@query(f"""WITH {_CLUSTERS}, best AS (SELECT * FROM cl QUALIFY row_number() OVER (PARTITION BY query_id, book_id ORDER BY score DESC, "start") = 1) SELECT query_id, book_id, greatest(1, "start") AS "start", least("end", greatest(1, "start") + 7) AS "end" FROM best""")
def candidate_window(spark, sf_dir):
    return evidence.candidate_windows(evidence.clusters(_found(spark, sf_dir), keys=_BY), keys=_BY)


@query(f"""WITH {_CLUSTERS}, e AS (SELECT query_id, book_id, min(chapter_index) AS a, max(chapter_index) AS z FROM sc GROUP BY 1, 2)
SELECT query_id, book_id, 'first' AS edge, greatest(1, a - 1) AS "start", least(greatest(greatest(1, a - 1), a + 1), greatest(1, a - 1) + 3) AS "end" FROM e UNION ALL SELECT query_id, book_id, 'last', greatest(1, z - 1), least(greatest(greatest(1, z - 1), z + 1), greatest(1, z - 1) + 3) FROM e""")
def edge_windows(spark, sf_dir):
    found = _found(spark, sf_dir)
    return evidence.edge_windows(found, "first", _BY).withColumn("edge", F.lit("first")).unionByName(evidence.edge_windows(found, "last", _BY).withColumn("edge", F.lit("last")))


@query(f"""WITH {_SCORED}, g AS (SELECT book_id, rank // 5 AS part, greatest(least(0.95, max(score)), CASE WHEN bool_or(source = 'chapters') THEN 0.9 WHEN bool_or(source = 'plots') THEN 0.62 WHEN bool_or(source IN ('characters', 'origanizations', 'special_existences', 'world_rules')) THEN 0.55 ELSE 0 END) AS c, max(rank % 6) AS t FROM sv GROUP BY 1, 2)
SELECT book_id, part, round(CASE WHEN t >= 4 AND c > 0.1 THEN least(0.95, c + 0.03) ELSE c END, 3) AS confidence FROM g UNION ALL SELECT DISTINCT book_id, -1, 0.18 FROM sv""")
def confidence(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("part", F.floor(F.col("rank") / 5)).withColumn("tools", F.col("rank") % 6)
    rows = rows.withColumn("k", F.struct("book_id", "part"))
    # Every book has a part that nothing was found for.
    asked = rows.select("k").unionAll(rows.select(F.struct("book_id", F.lit(-1).cast("bigint").alias("part")).alias("k")))
    found = evidence.confidence(rows, "k", "tools", asked)
    return found.select("k.book_id", "k.part", "confidence")


@query(f"""WITH {_EV}, t AS (SELECT book_id, coalesce('Chapter ' || chapter_index, 'Plot ' || plot_id, 'Volume ' || volume_id) AS t, min(rank) AS r FROM ev GROUP BY 1, 2), k AS (SELECT * FROM t WHERE t IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY r, t) <= 6)
SELECT book_id, string_agg(t, '; ' ORDER BY r, t) AS citations FROM k GROUP BY book_id""")
def citations(spark, sf_dir):
    return evidence.citations(_evidence(spark, sf_dir), "book_id")


@query(f"""WITH {_EV} SELECT book_id, coalesce((count(DISTINCT chapter_index) >= 3 AND max(chapter_index) - min(chapter_index) > 40) OR (count(DISTINCT plot_id) >= 3 AND NOT bool_or(source = 'chapters')), false) AS conflicting FROM ev GROUP BY book_id""")
def evidence_conflict(spark, sf_dir):
    return evidence.conflicts(_evidence(spark, sf_dir), "book_id")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def grounding(spark, sf_dir):
    passages = tables.table(spark, sf_dir, "benchmark", "item_id", "text").withColumnRenamed("text", "passage")
    return evidence.contained(passages, tables.table(spark, sf_dir, "documents", "doc_id", "text"))


# --- graph


@query("""WITH e AS (SELECT DISTINCT s_nationkey AS s, c_nationkey AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey), d AS (SELECT n, count(*) AS d FROM (SELECT s AS n FROM e UNION ALL SELECT t FROM e) GROUP BY n)
SELECT n_nationkey::BIGINT AS node_id, n_name AS name, coalesce(d, 0)::BIGINT AS degree, (18 + least(20, 3 * coalesce(d, 0)))::BIGINT AS size FROM nation LEFT JOIN d ON n = n_nationkey""")
def graph_nodes(spark, sf_dir):
    edges = tables.relation_events(spark, sf_dir).select("source_id", "target_id").distinct()
    nodes = tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("node_id"), F.col("n_name").alias("name"))
    return graph.degrees(nodes, edges).withColumn("size", F.col("size").cast("bigint"))


_STATUS = "CASE polarity WHEN 'negative' THEN CASE strength WHEN 'high' THEN '公开冲突' ELSE '敌对' END WHEN 'positive' THEN CASE strength WHEN 'high' THEN '结盟' ELSE '合作信任' END ELSE '普通相识' END"


@query(f"""WITH {EVENTS}, l AS (SELECT source_id, target_id, {_STATUS} AS status FROM rel QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY chapter_end DESC, summary DESC, polarity DESC, strength DESC) = 1)
SELECT source_id, target_id, a.n_name AS source_name, b.n_name AS target_name, CASE WHEN contains(status, '敌') OR contains(status, '冲突') THEN 'hostile' WHEN contains(status, '盟') OR contains(status, '信任') OR contains(status, '合作') THEN 'friendly' ELSE 'neutral' END AS category,
  CASE WHEN contains(status, '敌') OR contains(status, '冲突') THEN 'rgba(248,113,113,0.72)' WHEN contains(status, '盟') OR contains(status, '信任') OR contains(status, '合作') THEN 'rgba(56,189,248,0.72)' ELSE 'rgba(148,163,184,0.5)' END AS color,
  row_number() OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id) ORDER BY source_id, target_id) AS pair_index, count(*) OVER (PARTITION BY least(source_id, target_id), greatest(source_id, target_id)) AS pair_count
FROM l JOIN nation a ON a.n_nationkey = source_id JOIN nation b ON b.n_nationkey = target_id""")
def graph_edges(spark, sf_dir):
    rows = tables.relation_events(spark, sf_dir).select("source_id", "target_id", "chapter_end", "summary", "polarity", "strength")
    edges = graph.latest(rows, ["source_id", "target_id"], "chapter_end")
    nodes = tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name").select(F.col("n_nationkey").cast("bigint").alias("node_id"), F.col("n_name").alias("name"))
    found = graph.parallel(graph.with_ends(edges, nodes))
    status = tables.statuses(F.col("polarity"), F.col("strength"))
    return found.select("source_id", "target_id", "source_name", "target_name", graph.category(status).alias("category"), graph.edge_color(status).alias("color"), F.col("pair_index").cast("bigint").alias("pair_index"), "pair_count")


@query("""WITH n AS (SELECT 'k' || c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE 0 END AS cid, [c_name, c_mktsegment || (c_custkey % 900)] AS al FROM customer WHERE c_custkey % 3 <> 0),
w AS (SELECT c_custkey AS want_id, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 0 END AS cid, [c_name, c_mktsegment || (c_custkey % 900)] AS al FROM customer),
i AS (SELECT want_id, min(k) AS k FROM w JOIN n ON w.cid = n.cid AND w.cid > 0 GROUP BY 1), s AS (SELECT want_id, min(k) AS k FROM (SELECT want_id, unnest(al) AS a FROM w) x JOIN (SELECT k, unnest(al) AS a FROM n WHERE cid = 0) y USING (a) GROUP BY 1 HAVING count(DISTINCT k) = 1)
SELECT w.want_id, coalesce(i.k, s.k, 'new:' || w.want_id) AS graph_key, CASE WHEN i.k IS NOT NULL THEN 'id' WHEN s.k IS NOT NULL THEN 'stub' ELSE 'new' END AS how FROM w LEFT JOIN i USING (want_id) LEFT JOIN s USING (want_id)""")
def node_resolution(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    alias, of = F.array(F.concat("c_mktsegment", (F.col("c_custkey") % 900).cast("string"))), lambda k: F.when(F.col("c_custkey") % k == 0, F.col("c_custkey")).otherwise(0)
    nodes = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("graph_key"), of(2).alias("character_id"), F.col("c_name").alias("name"), alias.alias("aliases"))
    wanted = c.select(F.col("c_custkey").alias("want_id"), of(4).alias("character_id"), F.col("c_name").alias("name"), alias.alias("aliases"))
    return graph.resolve_nodes(wanted, nodes)


# --- writes

_SYNC = """nw AS (SELECT c_nationkey::BIGINT AS book_id, c_custkey AS k, c_mktsegment AS h FROM customer WHERE c_custkey % 5 <> 0), od AS (SELECT c_nationkey::BIGINT AS book_id, c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE c_mktsegment END AS h FROM customer WHERE c_custkey % 11 <> 0),
ac AS (SELECT coalesce(nw.book_id, od.book_id) AS book_id, coalesce(nw.k, od.k) AS k, CASE WHEN nw.k IS NULL THEN 'delete' WHEN od.k IS NULL THEN 'insert' WHEN nw.h = od.h THEN 'skip' ELSE 'update' END AS action FROM nw FULL JOIN od ON nw.book_id = od.book_id AND nw.k = od.k)"""


def _sync(spark, sf_dir):
    c = tables.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey", "c_mktsegment").select(F.col("c_nationkey").cast("bigint").alias("book_id"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("h"))
    old = c.where("k % 11 <> 0").withColumn("h", F.when(F.col("k") % 7 == 0, "x").otherwise(F.col("h")))
    return sync.actions(c.where("k % 5 <> 0"), old, ["book_id", "k"], "h")


@query(f"WITH {_SYNC} SELECT * FROM ac")
def entity_sync_actions(spark, sf_dir):
    return _sync(spark, sf_dir)


@query(f"WITH {_SYNC} SELECT book_id, count(*) FILTER (WHERE action = 'insert') AS inserted, count(*) FILTER (WHERE action = 'update') AS updated, count(*) FILTER (WHERE action = 'skip') AS skipped, count(*) FILTER (WHERE action = 'delete') AS deleted FROM ac GROUP BY 1")
def sync_counts(spark, sf_dir):
    return sync.action_counts(_sync(spark, sf_dir), "book_id")


@query("""WITH o AS (SELECT conv_id AS session_id, min(role) AS kind, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE 't' || conv_id END AS title FROM conversations GROUP BY conv_id), n AS (SELECT conv_id + 20 AS session_id, 'qa' AS kind, CASE WHEN conv_id % 2 = 0 THEN NULL ELSE 'n' || conv_id END AS title FROM conversations GROUP BY conv_id)
SELECT coalesce(n.session_id, o.session_id) AS session_id, coalesce(n.kind, o.kind) AS kind, coalesce(n.title, o.title) AS title FROM o FULL JOIN n ON o.session_id = n.session_id""")
def session_upsert(spark, sf_dir):
    c = tables.table(spark, sf_dir, "conversations", "conv_id", "role").groupBy("conv_id").agg(F.min("role").alias("kind"))
    title = lambda k, p, i: F.when(F.col("conv_id") % k != i, F.concat(F.lit(p), F.col("conv_id").cast("string")))
    old = c.select(F.col("conv_id").alias("session_id"), "kind", title(3, "t", 0).alias("title"))
    new = c.select((F.col("conv_id") + 20).alias("session_id"), F.lit("qa").alias("kind"), title(2, "n", 0).alias("title"))
    return sync.upserted(new, old, "session_id", ["kind"])


@query("SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)")
def stale_ids(spark, sf_dir):
    """Parts that no large returned item wants any more."""
    rows = tables.table(spark, sf_dir, "lineitem", "l_partkey", "l_returnflag", "l_quantity").withColumnRenamed("l_partkey", "id")
    return sync.stale(rows, rows.where("l_returnflag = 'R' AND l_quantity > 45"), ["id"])


@query(f"WITH {INDEX} SELECT 'chapters' AS store, count(*) AS deleted FROM ci WHERE book_id = 3 UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE label = 3 UNION ALL SELECT 'characters', count(*) FROM customer WHERE c_nationkey = 3")
def cascade_counts(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings", "label").withColumnRenamed("label", "book_id")
    people = tables.table(spark, sf_dir, "customer", "c_nationkey").withColumnRenamed("c_nationkey", "book_id")
    return sync.cascade_counts({"chapters": tables.chapter_index(spark, sf_dir), "vectors": vectors, "characters": people}, 3)


@query("SELECT item_id, (SELECT max(p_partkey) FROM part) + row_number() OVER (ORDER BY text, item_id) AS id FROM benchmark")
def next_ids(spark, sf_dir):
    stored = tables.table(spark, sf_dir, "part", "p_partkey").withColumnRenamed("p_partkey", "id")
    return sync.next_ids(tables.table(spark, sf_dir, "benchmark", "item_id", "text"), stored, ["text", "item_id"]).select("item_id", "id")


@query("SELECT doc_id, CASE WHEN quality = 1 THEN 'success' WHEN toxic = 1 THEN 'pending' ELSE 'pending' END AS status FROM labels")
def status_reset(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "success").when(F.col("toxic") == 1, "processing").otherwise("pending").alias("status"))
    return sync.reset_interrupted(rows)


# --- sessions and questions


@query(f"WITH {MESSAGES} SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY message_id DESC) <= 3")
def recent_messages(spark, sf_dir):
    return sessions.recent(tables.messages(spark, sf_dir), 3)


@query(f"WITH {MESSAGES} SELECT session_id, count(*) AS new_messages, max(message_id) AS latest_id FROM messages WHERE message_id > session_id % 4 GROUP BY 1 HAVING count(*) > 2")
def summary_due(spark, sf_dir):
    rows = tables.messages(spark, sf_dir)
    marks = rows.groupBy("session_id").agg((F.first("session_id") % 4).alias("last_id"))
    return sessions.summary_due(rows, marks, 2)


@query(f"WITH {MESSAGES} SELECT session_id, count(*) FILTER (WHERE role = 'assistant') AS calls, coalesce(sum(token_count) FILTER (WHERE role = 'user'), 0)::BIGINT AS input_tokens, coalesce(sum(token_count) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output_tokens FROM messages GROUP BY 1")
def request_metrics(spark, sf_dir):
    return sessions.metrics(tables.messages(spark, sf_dir))


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 20")
def paged_cards(spark, sf_dir):
    return sessions.page(tables.table(spark, sf_dir, "customer", "c_custkey", "c_acctbal"), [F.desc("c_acctbal"), F.asc("c_custkey")], 3)


@query("""WITH b AS (SELECT DISTINCT source AS book_id FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY md5(book_id || ':7'), book_id) AS i, count(*) OVER () AS c FROM b)
SELECT book_id, CASE WHEN c >= 2 AND i <= greatest(1, round_even(c * 0.25, 0)) THEN 'validation' ELSE 'train' END AS split FROM n""")
def book_split(spark, sf_dir):
    return dataset.book_split(tables.table(spark, sf_dir, "documents", "source").select(F.col("source").alias("book_id")))


@query("""WITH b AS (SELECT DISTINCT source AS book_id FROM documents), t AS (SELECT book_id, 'train' AS split FROM b WHERE right(book_id, 1) < '6' UNION ALL SELECT book_id || 'x', 'train' FROM b WHERE right(book_id, 1) = '9' UNION ALL SELECT book_id, 'validation' FROM b WHERE right(book_id, 1) > '4')
SELECT book_id, split, CASE WHEN book_id NOT IN (SELECT book_id FROM b) THEN 'unknown book' WHEN count(*) OVER (PARTITION BY book_id) > 1 THEN 'in both lists' END AS fault FROM t""")
def checked_split(spark, sf_dir):
    b = tables.table(spark, sf_dir, "documents", "source").select(F.col("source").alias("book_id")).distinct()
    last = F.expr("right(book_id, 1)")
    train = b.where(last < "6").unionByName(b.where(last == "9").select(F.concat("book_id", F.lit("x")).alias("book_id")))
    return dataset.checked_split(b, train, b.where(last > "4"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5")
def topk_per_key(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return ranks.top_per_key(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 5).drop("rank")


@query("SELECT event_id, least(3600, 60 * power(2, event_id % 9))::BIGINT AS delay, greatest(1, event_id % 50) AS window_start, least(greatest(greatest(1, event_id % 50), event_id % 77), greatest(1, event_id % 50) + 7) AS window_end, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def event_numbers(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "props")
    n = F.col("event_id")
    return rows.select("event_id", keys.retry_delay(n % 9).alias("delay"), F.greatest(F.lit(1), n % 50).cast("bigint").alias("window_start"), keys.clipped_end(n % 50, n % 77).cast("bigint").alias("window_end"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


_KEYS = "k AS (SELECT doc_id, trim(text) AS t, list_sort([source, lang, string_split_regex(trim(text), '\\s+')[5], string_split_regex(trim(text), '\\s+')[-1]]) AS words FROM documents)"


@query(rf"""WITH {_KEYS}, h AS (SELECT doc_id, t, unnest(list_filter(words, lambda w: w IS NOT NULL AND w <> '')) AS w FROM k), sp AS (SELECT doc_id, t, greatest(0, instr(t, w) - 1 - 100) AS a, least(length(t), instr(t, w) - 1 + 150) AS z FROM h WHERE instr(t, w) > 0),
p AS (SELECT doc_id, a, z, row_number() OVER (PARTITION BY doc_id ORDER BY a, z) AS n, trim(substr(t, a + 1, z - a)) AS piece FROM sp), c AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p WHERE piece <> ''),
j AS (SELECT doc_id, string_agg(left(piece, (300 - used)::BIGINT), chr(10) || '...' || chr(10) ORDER BY n) AS x FROM c WHERE used < 300 GROUP BY doc_id)
SELECT k.doc_id, sha256(CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = k.doc_id) THEN left(trim(coalesce(x, '')), 300) ELSE left(t, 300) END) AS excerpt_sha256 FROM k LEFT JOIN j USING (doc_id)""")
def excerpts(spark, sf_dir):
    words = F.split(F.trim("text"), r"\s+")
    keywords = F.filter(F.array("source", "lang", F.get(words, F.lit(4)), F.try_element_at(words, F.lit(-1))), lambda w: F.coalesce(w, F.lit("")) != "")
    rows = tables.table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang")
    return rows.select("doc_id", F.sha2(profiles.excerpts(F.col("text"), keywords, 300), 256).alias("excerpt_sha256"))


@query("SELECT p_partkey, CASE WHEN instr(p_name, right(p_brand, 1)) > 0 THEN substr(p_name, greatest(1, instr(p_name, right(p_brand, 1)) - 2), least(instr(p_name, right(p_brand, 1)), 3) + 2) ELSE substr(p_name, 1, 4) END AS excerpt FROM part")
def keyword_excerpts(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").withColumn("word", F.expr("right(p_brand, 1)"))
    return rows.select("p_partkey", text.keyword_excerpt("p_name", "word", 2).alias("excerpt"))


# --- searches and merges without SQL, and the rest


def _asked(spark, sf_dir):
    """Every benchmark passage as a question to the book of its number; numbers go round the books that there are."""
    books = tables.table(spark, sf_dir, "documents", "source").agg(F.count_distinct(F.coalesce("source", F.lit("")))).scalar()
    return tables.table(spark, sf_dir, "benchmark", "item_id", "text").select(F.col("item_id").alias("query_id"), (F.col("item_id") % books + 1).alias("book_id"), F.col("text").alias("query"))


@query()
def hybrid_search(spark, sf_dir):
    """Every benchmark passage as a question to the book of its number, over all chapters."""
    chapters = tables.contents(spark, sf_dir)
    asked = _asked(spark, sf_dir)
    found = search.hybrid(asked, chapters.select(F.col("doc_id").alias("id"), "book_id", F.col("content").alias("text")), "volumes")
    return found.select("query_id", "id", F.round("fused_score", 9).alias("fused_score"), F.round("rerank_score", 6).alias("rerank_score"), F.col("final_rank").cast("bigint").alias("final_rank"))


@query()
def deep_search(spark, sf_dir):
    """The windows, confidence and citations of every benchmark passage as a question."""
    chapters = tables.contents(spark, sf_dir).select(F.col("doc_id").alias("id"), "book_id", "chapter_index", F.col("content").alias("text"))
    return search.research(_asked(spark, sf_dir), chapters)


@query()
def plot_entity_merge(spark, sf_dir):
    """The distinct capitalised words of whole chapters as named entries, with the word that follows each as an alias, merged within each plot."""
    rows = tables.with_hierarchy(tables.contents(spark, sf_dir).select("book_id", "chapter_index", "content"))
    found = F.array_distinct(F.regexp_extract_all("content", F.lit(r"(\p{Lu}\p{Ll}{3,}) (\p{L}{4,})"), F.lit(0)))
    words = rows.select("book_id", "plot_id", "chapter_index", F.posexplode(found).alias("pos", "w"))
    named = words.select("book_id", "plot_id", "chapter_index", "pos", F.concat(F.substring_index("w", " ", 1), F.lit("（"), F.substring_index("w", " ", -1), F.lit("）")).alias("name"), F.concat(F.lit("seen in "), F.col("chapter_index").cast("string")).alias("description"))
    merged = entries.merged_entries(named)
    return merged.select("book_id", "plot_id", "place", "name", F.array_join("aliases", "/").alias("aliases"), F.size("records").alias("n_records"))


@query(f"""WITH {CHAPTERS}, b AS (SELECT book_id, (chapter_index - 1) // 5 AS batch, list(chapter_index ORDER BY chapter_index) FILTER (WHERE word_count % 3 = 0) AS hits, arg_max(chapter_summary, word_count * 1000 + chapter_index) AS ev, bool_or(word_count % 5 = 0) AS full_text, bool_or(word_count > 4000) AS has_long FROM chapters GROUP BY 1, 2)
SELECT book_id, array_to_string(list_sort(list_distinct(flatten(list(coalesce(hits, []))))), ',') AS hit_chapters, arg_max(trim(ev), (length(trim(ev)), -batch)) AS best_evidence, bool_or(full_text) AS needs_fulltext, count(*) FILTER (WHERE hits IS NOT NULL) AS matched_batches, bool_or(has_long) AS has_long, CASE WHEN sum(coalesce(len(hits), 0)) > 0 THEN 'HIT' ELSE 'MISS' END AS status FROM b GROUP BY 1""")
def structured_agg(spark, sf_dir):
    c = tables.cards(spark, sf_dir)
    hit = F.array_sort(F.collect_list(F.when(F.col("word_count") % 3 == 0, F.col("chapter_index"))))
    b = c.groupBy("book_id", F.floor((F.col("chapter_index") - 1) / 5).alias("batch")).agg(hit.alias("hit_chapters"), F.max_by("chapter_summary", F.col("word_count") * 1000 + F.col("chapter_index")).alias("best_evidence"), F.bool_or(F.col("word_count") % 5 == 0).alias("needs_fulltext"), F.bool_or(F.col("word_count") > 4000).alias("has_long"))
    found = evidence.structured(b.withColumn("status", F.when(F.size("hit_chapters") > 0, "hit").otherwise("miss")), "book_id", ["has_long"])
    return found.select("book_id", F.array_join(F.transform("hit_chapters", lambda x: x.cast("string")), ",").alias("hit_chapters"), "best_evidence", "needs_fulltext", "matched_batches", "has_long", "status")


_HISTORIES = """asked AS (SELECT item_id % (SELECT count(*) FROM books) + 1 AS book_id, item_id, lower(string_split(trim(text), ' ')[1]) AS target, lower(string_split(trim(text), ' ')[2]) AS second, string_split(trim(text), ' ')[3] AS third FROM benchmark),
names AS (SELECT target, list_distinct(list_filter([target, trim(coalesce(arg_min(second, item_id), '')), trim(coalesce(arg_min(third, item_id), ''))], lambda x: x <> '')) AS names FROM asked GROUP BY target),
hist AS (SELECT DISTINCT book_id, target, unnest(range(least(x, y), greatest(x, y) + 1)) AS chapter_index FROM (SELECT book_id, target, item_id % 17 + 1 AS x, item_id % 29 + 1 AS y FROM asked WHERE target <> ''))"""
_RELATED = f"""{INDEX}, {_HISTORIES}, rr AS (SELECT book_id, target, volume_id, chapter_index, content, list_sum(list_transform(names, lambda a: (length(content) - length(replace(content, a, ''))) // length(a))) AS m FROM hist JOIN ci USING (book_id, chapter_index) JOIN names USING (target)),
rs AS (SELECT book_id, target, volume_id, chapter_index, m, m > 0 AND (contains(content, 'was') OR contains(content, 'ist')) AS acts, chapter_index = min(chapter_index) OVER v AS starts, chapter_index = max(chapter_index) OVER v AS ends,
  (6 + CASE WHEN m >= 2 THEN 3 ELSE 0 END + CASE WHEN acts THEN 6 ELSE 0 END + CASE WHEN starts THEN 2 ELSE 0 END + CASE WHEN ends THEN 2 ELSE 0 END)::BIGINT AS score,
  concat_ws('；', '已识别关系证据', CASE WHEN acts THEN '存在明确互动' END, CASE WHEN m >= 2 THEN '双向提及概率较高' END, CASE WHEN starts THEN '本卷关系起点' END, CASE WHEN ends THEN '本卷关系终点' END) AS reasons
FROM rr WINDOW v AS (PARTITION BY book_id, target, volume_id))"""


def _relations(spark, sf_dir):
    """(histories, aliases): every benchmark passage's first word as a relation's other side in the book of the passage's number, over chapters that the number gives; the next two words are its aliases."""
    n, w = F.col("query_id"), F.split(F.trim("query"), " ")
    asked = _asked(spark, sf_dir).select(n, "book_id", F.lower(w[0]).alias("target"), F.lower(F.get(w, F.lit(1))).alias("second"), F.get(w, F.lit(2)).alias("third"))
    aliases = asked.groupBy("target").agg(F.min_by("second", "query_id").alias("a"), F.min_by("third", "query_id").alias("b")).select("target", F.array_compact(F.array("a", "b")).alias("aliases"))
    return asked.where("target <> ''").select("book_id", "target", (n % 17 + 1).alias("start"), (n % 29 + 1).alias("end")), aliases


def _related(spark, sf_dir):
    rows = tables.with_hierarchy(tables.contents(spark, sf_dir)).select("book_id", "chapter_index", "volume_id", F.col("content").alias("text"))
    histories, aliases = _relations(spark, sf_dir)
    return relations.chapter_scores(rows, histories, ((6, ("was", "ist"), "存在明确互动"),), ["book_id"], aliases).withColumn("score", F.col("score").cast("bigint"))


@query(f"WITH {_RELATED} SELECT book_id, target, volume_id, chapter_index, score, reasons FROM rs")
def relation_scores(spark, sf_dir):
    return _related(spark, sf_dir).withColumn("reasons", F.array_join("reasons", "；"))


_CHOSEN = f"""{_RELATED}, f AS (SELECT *, sum(CASE WHEN score >= 6 AND score < 10 THEN 1 ELSE 0 END) OVER (PARTITION BY book_id, target, volume_id ORDER BY score DESC, chapter_index ROWS UNBOUNDED PRECEDING) AS nth, chapter_index IN (min(chapter_index) OVER v, max(chapter_index) OVER v) AS edge FROM rs WINDOW v AS (PARTITION BY book_id, target, volume_id)),
ch AS (SELECT book_id, target, volume_id, chapter_index, score, reasons FROM f WHERE edge OR score >= 10 OR (score >= 6 AND nth <= 2) QUALIFY row_number() OVER (PARTITION BY book_id, target, volume_id ORDER BY score DESC, chapter_index) <= 5),
near AS (SELECT DISTINCT book_id, target, chapter_index + d AS chapter_index FROM ch, (VALUES (-1), (1)) t(d)),
cx AS (SELECT book_id, target, chapter_index, score, reasons, false AS is_context FROM ch UNION ALL SELECT book_id, target, chapter_index, 0, '邻接上下文', true FROM near SEMI JOIN ci USING (book_id, chapter_index) ANTI JOIN ch USING (book_id, target, chapter_index))"""


@query(f"WITH {_CHOSEN} SELECT * FROM cx")
def relation_critical(spark, sf_dir):
    """The critical chapters of every relation with their reasons, and the chapters beside them as context."""
    chosen = relations.critical_chapters(_related(spark, sf_dir), ["book_id"])
    return relations.with_context(chosen, tables.chapter_index(spark, sf_dir), ["book_id"]).withColumn("reasons", F.array_join("reasons", "；"))


@query(f"""WITH {_CHOSEN}, k AS (SELECT cx.*, volume_id, chapter_summary, trim(content) AS t, list_distinct(list_concat([b.source], names)) AS words FROM cx JOIN names USING (target) JOIN books b USING (book_id) JOIN ci USING (book_id, chapter_index)),
h AS (SELECT book_id, target, chapter_index, t, unnest(list_filter(words, lambda w: coalesce(trim(w), '') <> '')) AS w FROM k), sp AS (SELECT *, greatest(0, instr(t, trim(w)) - 1 - 80) AS a, least(length(t), instr(t, trim(w)) - 1 + 120) AS z FROM h WHERE instr(t, trim(w)) > 0),
p AS (SELECT book_id, target, chapter_index, a, z, row_number() OVER (PARTITION BY book_id, target, chapter_index ORDER BY a, z) AS n, trim(substr(t, a + 1, z - a)) AS piece FROM sp), c AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY book_id, target, chapter_index ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM p WHERE piece <> ''),
j AS (SELECT book_id, target, chapter_index, string_agg(left(piece, (240 - used)::BIGINT), chr(10) || '...' || chr(10) ORDER BY n) AS x FROM c WHERE used < 240 GROUP BY ALL)
SELECT book_id, target, chapter_index, score, reasons, is_context, volume_id, chapter_summary, sha256(CASE WHEN EXISTS (SELECT 1 FROM sp WHERE sp.book_id = k.book_id AND sp.target = k.target AND sp.chapter_index = k.chapter_index) THEN left(trim(coalesce(x, '')), 240) ELSE left(t, 240) END) AS excerpt_sha256 FROM k LEFT JOIN j USING (book_id, target, chapter_index)""")
def relation_packets(spark, sf_dir):
    """The critical chapters and their context with summaries and the text around the names of both sides; a book's own name is its source."""
    histories, aliases = _relations(spark, sf_dir)
    chapters = tables.with_hierarchy(tables.chapters(spark, sf_dir)).select("book_id", "chapter_index", "volume_id", "chapter_summary", "content")
    chosen = relations.critical_chapters(_related(spark, sf_dir), ["book_id"])
    rows = relations.with_context(chosen, tables.chapter_index(spark, sf_dir), ["book_id"])
    own = tables.with_book(tables.table(spark, sf_dir, "documents", "source").distinct()).select("book_id", F.array_compact(F.array("source")).alias("own"))
    found = relations.packets(rows, chapters, own, aliases, ["book_id"], 240)
    return found.withColumn("reasons", F.array_join("reasons", "；")).withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")
