"""Queries over names, candidates, grounding and facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import aliases, names
from inkloom.operators import candidates, facts, grounding
from inkloom.plans.base import CHAPTERS, INDEX, query
from inkloom.sources import tables

#: What stands in a part's or customer's place as a name; the table's own columns fill in the rest.
_FORMS = ("那个老人", "某位老师", "{}的老板", "老王", "小李", "一个女人", "校长", "青年的朋友", "女秘书", "{}经理", "{}", "{}先生")


def _spark_form(number, own):
    return F.get(F.array(*[F.concat(*[own if p is None else F.lit(p) for p in _pieces(f)]) for f in _FORMS]), (number % len(_FORMS)).cast("int"))


def _pieces(form: str) -> list[str | None]:
    head, brace, tail = form.partition("{}")
    return [head, None, tail] if brace else [head]


def _sql_form(number: str, own: str) -> str:
    one = lambda f: " || ".join(own if p is None else f"'{p}'" for p in _pieces(f) if p != "")
    return f"[{', '.join(map(one, _FORMS))}][{number} % {len(_FORMS)} + 1]"


_LIST = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_ANY = lambda words: "(?:" + "|".join(words) + ")"
_NAMED = f"""nm AS (SELECT p_partkey, {_sql_form("p_partkey", "p_brand")} AS raw FROM part), tn AS (SELECT *, regexp_replace(raw, '\\s+', '', 'g') AS t FROM nm),
an AS (SELECT *, regexp_matches(t, '^[^的]+的.*{_ANY(names.RELATIONS)}$') AND strpos(t, '的') > 1 AS anchored FROM tn),
gn AS (SELECT *, NOT anchored AND (t IN {_LIST(names.BLOCKED["characters"])} OR t IN {_LIST(names.RELATIONS)} OR regexp_matches(t, '{names.BLOCKED_PATTERNS["characters"]}')) AS generic, NOT anchored AND left(t, 1) IN ('小', '老', '阿') AS nickname FROM an)"""


@query(f"""WITH {_NAMED} SELECT p_partkey, raw, anchored, generic, nickname, CASE WHEN NOT anchored AND NOT nickname AND length(t) >= 2 AND NOT regexp_matches(t, '{_ANY(names.DESCRIPTIONS)}$') THEN 0 WHEN anchored THEN 1 WHEN nickname THEN 3 ELSE 2 END AS rank,
  CASE WHEN regexp_matches(t, '.{_ANY(names.HONORIFICS)}$') THEN left(t, length(t) - 2) ELSE '' END AS root, CASE WHEN anchored THEN t ELSE regexp_replace(t, '{names.PREFIXES["characters"]}', '') END AS normal FROM gn""")
def name_rules(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_brand")
    raw = _spark_form(F.col("p_partkey"), F.col("p_brand"))
    rows = rows.select("p_partkey", raw.alias("raw"))
    of = F.col("raw")
    return rows.select("p_partkey", "raw", names.anchored(of).alias("anchored"), names.generic(of).alias("generic"), names.nickname(of).alias("nickname"), names.name_rank(of)["rank"].alias("rank"), names.root(of).alias("root"), names.normal_alias("characters", of).alias("normal"))


@query(f"""WITH e AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '这个组织' WHEN 1 THEN s_name || ' / ' || '某个公司' ELSE '一家' || s_name || '的公司' END AS name, ['公司', s_name || '的集团', '那个' || s_name, s_name] AS al FROM supplier),
sp AS (SELECT s_suppkey, trim(string_split(name, '/')[1]) AS head, list_transform(string_split(name, '/') || al, lambda x: trim(x)) AS parts FROM e),
k AS (SELECT s_suppkey, head, list_filter(parts, lambda x: regexp_replace(x, '\\s+', '', 'g') NOT IN {_LIST(names.BLOCKED["origanizations"])} AND NOT regexp_matches(regexp_replace(x, '\\s+', '', 'g'), '{names.BLOCKED_PATTERNS["origanizations"]}')) AS kept FROM sp),
n AS (SELECT s_suppkey, regexp_replace(regexp_replace(regexp_replace(head, '\\s+', '', 'g'), '{names.PREFIXES["origanizations"]}', ''), '^(.+?)的(公司|集团)$', '\\1\\2') AS own, list_transform(kept, lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\\s+', '', 'g'), '{names.PREFIXES["origanizations"]}', ''), '^(.+?)的(公司|集团)$', '\\1\\2')) AS al FROM k),
d AS (SELECT s_suppkey, own, list_filter(al, lambda x, i: list_position(al, x) = i) AS al FROM n)
SELECT s_suppkey, CASE WHEN list_contains(al, own) THEN own ELSE al[1] END AS name, array_to_string(al, '|') AS aliases FROM d""")
def entry_forms(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    own, k = F.col("s_name"), F.col("s_suppkey") % 3
    name = F.when(k == 0, "这个组织").when(k == 1, F.concat(own, F.lit(" / 某个公司"))).otherwise(F.concat(F.lit("一家"), own, F.lit("的公司")))
    listed = F.array(F.lit("公司"), F.concat(own, F.lit("的集团")), F.concat(F.lit("那个"), own), own)
    rows = rows.select("s_suppkey", names.normal_entry("origanizations", name, listed).alias("e"))
    return rows.select("s_suppkey", "e.name", F.array_join("e.aliases", "|").alias("aliases"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || '|' || c_mktsegment WHEN 1 THEN 'A|B|' || c_name || '|' || c_mktsegment WHEN 2 THEN 'J.R.|' || c_name ELSE c_mktsegment || '|' || c_name END AS aliases FROM customer""")
def alias_flat(spark, sf_dir):
    """Quoted, listed, bracketed and half-open aliases."""
    n, m, k = F.col("c_name"), F.col("c_mktsegment"), F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("“"), n, F.lit("”、["), m, F.lit("]"))).when(k == 1, F.concat(n, F.lit("（"), m, F.lit("）,A/B"))).when(k == 2, F.concat(F.lit("J.R.("), n)).otherwise(F.concat(F.lit("《"), m, F.lit("》；"), n, F.lit("）")))
    return tables.table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.array_join(aliases.flattened(text), "|").alias("aliases"))


def _people(spark, sf_dir):
    """Customers as items: some have a title after the name of another, some records tie them to a neighbour."""
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_name")
    key, other = F.col("c_custkey"), lambda d: F.format_string("Customer#%09d", F.col("c_custkey") + d)
    name = F.when(key % 5 == 0, F.concat(other(1), F.lit("先生"))).otherwise(F.col("c_name"))
    record = F.when(key % 7 == 0, F.concat(F.lit("后来改名为“"), other(3), F.lit("”了"))).when(key % 7 == 1, F.concat(F.lit("代号"), other(2))).otherwise(F.lit("没有别的名字"))
    return rows.select(F.col("c_custkey").alias("item_id"), name.alias("name"), F.array().cast("array<string>").alias("aliases"), F.array(F.struct(F.lit("1").alias("chapter"), record.alias("text"))).alias("records"))


_PEOPLE = """it AS (SELECT c_custkey AS item_id, CASE WHEN c_custkey % 5 = 0 THEN 'Customer#' || lpad((c_custkey + 1)::VARCHAR, 9, '0') || '先生' ELSE c_name END AS name, CASE WHEN c_custkey % 7 = 0 THEN c_custkey + 3 WHEN c_custkey % 7 = 1 THEN c_custkey + 2 END AS other FROM customer),
tie AS (SELECT a.item_id AS source_id, b.item_id AS target_id FROM it a JOIN it b ON a.item_id <> b.item_id AND ((a.item_id % 7 = 0 AND b.name = 'Customer#' || lpad(a.other::VARCHAR, 9, '0')) OR (a.item_id % 7 = 1 AND b.name = 'Customer#' || lpad(a.other::VARCHAR, 9, '0')))),
ro AS (SELECT b.item_id AS root_of, a.item_id FROM it b JOIN it a ON b.item_id % 5 = 0 AND (a.name = left(b.name, 18) OR a.name = b.name))"""


@query(f"WITH {_PEOPLE} SELECT * FROM tie")
def bridge_pairs(spark, sf_dir):
    return candidates.bridged(_people(spark, sf_dir))


@query(f"""WITH RECURSIVE {_PEOPLE}, ed AS (SELECT source_id AS a, target_id AS b FROM tie UNION SELECT target_id, source_id FROM tie UNION SELECT x.item_id, y.item_id FROM ro x JOIN ro y ON x.root_of = y.root_of AND x.item_id <> y.item_id),
reach(item_id, r) AS (SELECT DISTINCT a, a FROM ed UNION SELECT ed.b, reach.r FROM reach JOIN ed ON ed.a = reach.item_id AND reach.r < ed.b) SELECT min(r) AS group_id, item_id FROM reach GROUP BY item_id""")
def candidate_components(spark, sf_dir):
    return candidates.groups(_people(spark, sf_dir))


@query("""WITH r AS (SELECT DISTINCT l_suppkey AS item_id, CASE WHEN l_partkey % 5 = 0 THEN 'x' || l_linenumber ELSE (l_partkey % 50)::VARCHAR END AS chapter, l_returnflag AS text FROM lineitem)
SELECT item_id, chapter, text, row_number() OVER (PARTITION BY item_id ORDER BY try_cast(chapter AS BIGINT) IS NULL, try_cast(chapter AS BIGINT), chapter, text) AS nth FROM r""")
def merged_records(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_linenumber", "l_returnflag")
    chapter = F.when(F.col("l_partkey") % 5 == 0, F.concat(F.lit("x"), F.col("l_linenumber").cast("string"))).otherwise((F.col("l_partkey") % 50).cast("string"))
    return candidates.merged_records(rows.select(F.col("l_suppkey").alias("item_id"), chapter.alias("chapter"), F.col("l_returnflag").alias("text")), "item_id")


@query("""WITH r AS (SELECT l_suppkey AS item_id, l_orderkey AS chapter, l_returnflag || l_linestatus AS text, min(l_orderkey * 10 + l_linenumber) AS place, bool_or(l_returnflag = 'R') AS prioritised FROM lineitem GROUP BY 1, 2, 3)
SELECT item_id, chapter, text, row_number() OVER (PARTITION BY item_id ORDER BY prioritised DESC, place) AS nth FROM r QUALIFY nth <= 5""")
def evidence_snippets(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    rows = rows.select(F.col("l_suppkey").alias("item_id"), F.col("l_orderkey").alias("chapter"), F.concat("l_returnflag", "l_linestatus").alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return candidates.snippets(rows, F.col("text").startswith("R")).select("item_id", "chapter", "text", "nth")


@query(f"""WITH {CHAPTERS}, n AS (SELECT book_id, chapter_index, count(*) OVER (PARTITION BY book_id) AS c, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS i FROM chapters),
m AS (SELECT *, c > 30 AND i > 6 AND i <= c - 6 AS mid FROM n), l AS (SELECT *, row_number() OVER (PARTITION BY book_id, mid ORDER BY md5(book_id || ':' || chapter_index), chapter_index) AS luck FROM m) SELECT book_id, chapter_index FROM l WHERE NOT mid OR luck <= 18""")
def sampled_chapters(spark, sf_dir):
    return candidates.sampled_chapters(tables.chapter_index(spark, sf_dir), "book_id", 30, 6, 6)


@query("""WITH f AS (SELECT l_suppkey AS character_id, l_partkey AS chapter_index, l_returnflag || l_shipdate::DATE AS text, min(l_orderkey * 10 + l_linenumber) AS place FROM lineitem GROUP BY 1, 2, 3)
SELECT character_id, chapter_index, string_agg(text, '；' ORDER BY place, text) AS description FROM f GROUP BY 1, 2""")
def chapter_descriptions(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    text = F.concat("l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return candidates.chapter_descriptions(rows.select(F.col("l_suppkey").alias("character_id"), F.col("l_partkey").alias("chapter_index"), text.alias("text"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place")))


def _asked(spark, sf_dir):
    """Questions that name nations: as they are, without blanks and case, or by an alias; entities of two types share some names."""
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").join(tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    k, n = F.col("c_custkey") % 4, F.col("n_name")
    text = F.when(k == 0, F.concat(F.lit("who rules "), n, F.lit("?"))).when(k == 1, F.concat(F.lit("about "), F.lower(F.concat_ws(" ", F.substring(n, 1, 2), F.substring(n, 3, 99))))).when(k == 2, F.concat(F.lit("the land-"), F.col("n_nationkey").cast("string"), F.lit(" of old"))).otherwise(F.lit("nothing"))
    questions = rows.select(F.col("c_custkey").alias("query_id"), F.lit(0).alias("place"), text.alias("text"))
    nations, regions = tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name"), tables.table(spark, sf_dir, "region", "r_regionkey", "r_name")
    of = lambda kind, df, key, name, extra: df.select(F.lit(kind).alias("entity_type"), F.col(key).cast("bigint").alias("source_id"), F.col(name).alias("name"), extra.alias("aliases"))
    land = F.array(F.concat(F.lit("land-"), F.col("n_nationkey").cast("string"), F.lit(" ")))
    entities = of("origanizations", nations, "n_nationkey", "n_name", land).unionByName(of("world_rules", regions, "r_regionkey", "r_name", F.array(F.lower("r_name"))))
    return questions, entities


_ASKED = """q AS (SELECT c_custkey AS query_id, CASE c_custkey % 4 WHEN 0 THEN 'who rules ' || n_name || '?' WHEN 1 THEN 'about ' || lower(substr(n_name, 1, 2) || ' ' || substr(n_name, 3)) WHEN 2 THEN 'the land-' || n_nationkey || ' of old' ELSE 'nothing' END AS text FROM customer JOIN nation ON c_nationkey = n_nationkey),
e AS (SELECT 'origanizations' AS entity_type, n_nationkey::BIGINT AS source_id, n_name AS name, 'land-' || n_nationkey AS alias FROM nation UNION ALL SELECT 'world_rules', r_regionkey::BIGINT, r_name, lower(r_name) FROM region),
c AS (SELECT query_id, entity_type, source_id, name, CASE WHEN contains(text, name) OR (length(regexp_replace(name, '\\s+', '', 'g')) >= 2 AND contains(lower(regexp_replace(text, '\\s+', '', 'g')), lower(regexp_replace(name, '\\s+', '', 'g')))) THEN 1 ELSE 0 END AS by_name, contains(text, name) AS exact_name,
  contains(text, alias) AS exact_alias, contains(lower(regexp_replace(text, '\\s+', '', 'g')), lower(regexp_replace(alias, '\\s+', '', 'g'))) AS by_alias, alias FROM q, e),
m AS (SELECT query_id, entity_type, source_id, name, CASE WHEN exact_name THEN name WHEN exact_alias THEN alias WHEN by_name = 1 THEN name ELSE alias END AS matched, CASE WHEN exact_name THEN 'exact_name' WHEN exact_alias THEN 'exact_alias' ELSE 'substring_alias' END AS mode,
  CASE WHEN exact_name THEN 1.0 WHEN exact_alias THEN 0.97 WHEN by_name = 1 THEN 0.86 ELSE 0.84 END::DOUBLE AS confidence FROM c WHERE by_name = 1 OR by_alias),
gr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, length(matched) DESC, length(name) DESC, entity_type, source_id) AS nth FROM m QUALIFY nth <= 20)"""


@query(f"WITH {_ASKED} SELECT * FROM gr")
def entity_grounding(spark, sf_dir):
    return grounding.matches(*_asked(spark, sf_dir))


@query(f"""WITH {_ASKED}, p AS (SELECT query_id, count(*) FILTER (WHERE confidence >= 0.97) AS n, count(DISTINCT (entity_type, source_id)) FILTER (WHERE confidence >= 0.97) AS s, count(DISTINCT (entity_type, lower(regexp_replace(name, '\\s+', '', 'g')))) FILTER (WHERE confidence >= 0.97) AS t, arg_min(entity_type, CASE WHEN confidence >= 0.97 THEN nth END) AS k FROM gr GROUP BY 1),
r AS (SELECT q.query_id, k, CASE WHEN n IS NULL THEN 'no_grounding_match' WHEN n = 0 THEN 'no_high_confidence_grounding' WHEN s > 1 AND t > 1 THEN 'ambiguous_grounding' ELSE 'high_confidence_alias_grounding' END AS reason FROM q LEFT JOIN p USING (query_id))
SELECT r.query_id, reason = 'high_confidence_alias_grounding' AS applied, reason, CASE WHEN reason = 'high_confidence_alias_grounding' THEN k ELSE '' END AS entity_type,
  coalesce((SELECT string_agg(DISTINCT source_id::VARCHAR, ',' ORDER BY source_id::VARCHAR) FROM gr WHERE gr.query_id = r.query_id AND reason = 'high_confidence_alias_grounding' AND confidence >= 0.97 AND entity_type = k), '') AS source_ids FROM r""")
def grounding_decisions(spark, sf_dir):
    questions, entities = _asked(spark, sf_dir)
    found = grounding.decisions(questions, grounding.matches(questions, entities))
    return found.withColumn("source_ids", F.array_join(F.array_sort(F.transform("source_ids", lambda x: x.cast("string"))), ","))


@query("""SELECT 'character' AS entity_type, lower(o_clerk) AS name_key, lower(seg) AS alias_key, pr AS alias_type, min(seg) AS alias, min(m) AS first_seen, max(m) AS last_seen
FROM (SELECT c_mktsegment AS o_clerk, CASE WHEN o_orderkey % 2 = 0 THEN 'Seg - x' ELSE o_orderstatus END AS raw, CASE WHEN o_orderkey % 2 = 0 THEN 'Seg' ELSE o_orderstatus END AS seg, o_orderpriority AS pr, CASE WHEN o_orderkey % 5 > 0 THEN month(o_orderdate)::BIGINT END AS m FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 2, 3, 4""")
def alias_registry(spark, sf_dir):
    o, c = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate"), tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    alias = F.when(F.col("o_orderkey") % 2 == 0, "Seg - x").otherwise(F.col("o_orderstatus"))
    return facts.aliases_seen(rows.select(F.lit("character").alias("entity_type"), F.concat(F.lit("<"), "c_mktsegment", F.lit(">")).alias("name"), alias.alias("alias"), F.col("o_orderpriority").alias("alias_type"), F.when(F.col("o_orderkey") % 5 > 0, F.month("o_orderdate").cast("bigint")).alias("chapter_index")))


def _plot_lists(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").join(tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    nation = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    none = F.array().cast("array<string>")
    k = F.col("o_orderkey")
    return rows.select(k.alias("plot_id"), F.when(k % 3 > 0, k % 100).alias("volume_id"), F.when(k % 2 == 0, F.array("c_mktsegment")).otherwise(none).alias("protagonists"), F.array(nation).alias("important"), F.array("o_orderpriority").alias("organizations"), F.array("c_mktsegment", nation).alias("people"), F.when(k % 4 == 0, F.array("o_orderstatus")).otherwise(none).alias("factions"))


_PLOT_LISTS = """pl AS (SELECT o_orderkey AS plot_id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 100 END AS volume_id, c_mktsegment AS seg, 'N' || c_nationkey AS nat, o_orderpriority AS pri, o_orderstatus AS st FROM orders JOIN customer ON o_custkey = c_custkey),
en AS (SELECT plot_id, volume_id, 'character' AS entity_type, seg AS name, CASE WHEN plot_id % 2 = 0 THEN 2 ELSE 0 END AS w FROM pl UNION ALL SELECT plot_id, volume_id, 'character', nat, 1 FROM pl UNION ALL SELECT plot_id, volume_id, 'faction', CASE WHEN plot_id % 4 = 0 THEN st ELSE pri END, CASE WHEN plot_id % 4 = 0 THEN 0 ELSE 1 END FROM pl),
pe AS (SELECT entity_type, lower(regexp_replace(CASE WHEN contains(name, ' - ') THEN string_split(name, ' - ')[1] ELSE name END, '\\s+', '', 'g')) AS name_key, min(plot_id) AS first_plot, max(plot_id) AS last_plot, arg_min(volume_id, CASE WHEN volume_id IS NOT NULL THEN plot_id END) AS volume_id, max(w) > 0 AS is_core, CASE max(w) WHEN 2 THEN 'protagonist' WHEN 1 THEN 'important' END AS importance FROM en GROUP BY 1, 2)"""


@query(f"WITH {_PLOT_LISTS} SELECT * FROM pe")
def plot_entities(spark, sf_dir):
    return facts.plot_entities(_plot_lists(spark, sf_dir))


@query(f"""WITH {_PLOT_LISTS}, ids AS (SELECT *, row_number() OVER (ORDER BY entity_type, name_key) AS entity_id FROM pe) SELECT c_custkey, coalesce(min(entity_id) FILTER (WHERE entity_type = 'character'), min(entity_id) FILTER (WHERE entity_type = 'faction')) AS entity_id
FROM customer LEFT JOIN ids ON name_key = lower(CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN '5-LOW' ELSE 'nobody' END) GROUP BY c_custkey""")
def fact_entity_ids(spark, sf_dir):
    registry = facts.with_ids(facts.plot_entities(_plot_lists(spark, sf_dir)))
    k = F.col("c_custkey") % 3
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").select("c_custkey", F.when(k == 0, F.col("c_mktsegment")).when(k == 1, "5-LOW").otherwise("nobody").alias("name"))
    return facts.with_entity_ids(rows, registry).select("c_custkey", "entity_id")


@query("""WITH e AS (SELECT p_type AS name, p_partkey AS ord, p_brand AS b, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_size::VARCHAR END AS role FROM part), f AS (SELECT name, b, min(ord) AS o FROM e GROUP BY 1, 2)
SELECT e.name, min(ord) AS ord, (SELECT string_agg(b, ',' ORDER BY o) FROM f WHERE f.name = e.name) AS actions, arg_max(role, CASE WHEN trim(role) <> '' THEN ord END) AS role FROM e GROUP BY e.name""")
def presence_merge(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_type", "p_brand", "p_size").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("ord"), F.array("p_brand").alias("actions"), F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("role"))
    return facts.presence(rows, ["actions"], ["role"]).withColumn("actions", F.array_join("actions", ","))


@query(f"""WITH {INDEX}, st AS (SELECT plot_id * 10 + book_id AS asset_id, book_id, CASE WHEN chapter_index % 3 = 0 THEN 'cover' ELSE 'page' END AS asset_type FROM ci)
SELECT n.book_id, max(asset_id) AS asset_id, 'covers/' || n.book_id AS path FROM (SELECT DISTINCT book_id FROM ci) n LEFT JOIN st ON st.book_id = n.book_id AND asset_type = 'cover' GROUP BY n.book_id""")
def latest_assets(spark, sf_dir):
    index = tables.chapter_index(spark, sf_dir)
    stored = index.select((F.col("plot_id") * 10 + F.col("book_id")).alias("asset_id"), "book_id", F.when(F.col("chapter_index") % 3 == 0, "cover").otherwise("page").alias("asset_type"))
    return facts.latest_asset(stored, index.select("book_id").distinct().withColumn("path", F.concat(F.lit("covers/"), F.col("book_id").cast("string"))))
