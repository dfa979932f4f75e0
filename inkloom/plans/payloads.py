"""Queries over model answers. The answers are written from the tables' columns, with fields by their several names."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import payloads
from inkloom.plans.base import query
from inkloom.sources import tables


def _json(**columns):
    return F.to_json(F.struct(*[c.alias(n) for n, c in columns.items()]))


def _answers(spark, sf_dir):
    """A chapter's answer for each part: lists of objects, an object, bare names, in fences, or plain text."""
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    k, name, brand, kind = F.col("p_partkey") % 4, F.col("p_name"), F.col("p_brand"), F.col("p_type")
    people = F.array(F.struct(name.alias("name"), kind.alias("description")), F.struct(name.alias("name"), kind.alias("description")), F.struct(brand.alias("name"), F.lit("").alias("description")))
    full = _json(chapter_summary=F.concat(F.lit(" about "), name), characters=people, special_items=F.create_map(brand, kind), origanizations=F.array(F.struct(brand.alias("title"), kind.alias("info"))), world_rules=F.array(brand, kind), ambiguous_character_mentions=F.array(F.struct(name.alias("label"), kind.alias("note"), brand.alias("quote"))))
    bare = _json(chapter_summary=name, character=F.array(F.struct(brand.alias("item"), kind.alias("text"))))
    raw = F.when(k == 0, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(k == 1, bare).when(k == 2, F.concat(F.lit("  no object: "), name)).otherwise(F.lit(" "))
    return rows.select("p_partkey", raw.alias("raw"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'about ' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'no object: ' || p_name ELSE '' END AS chapter_summary, CASE p_partkey % 4 WHEN 0 THEN p_name || '：' || p_type || chr(10) || p_brand WHEN 1 THEN p_brand || '：' || p_type ELSE '' END AS "character",
  CASE WHEN p_partkey % 4 = 0 THEN p_brand || '：' || p_type END AS special_existence, CASE WHEN p_partkey % 4 = 0 THEN p_brand || '：' || p_type END AS organizations, CASE WHEN p_partkey % 4 = 0 THEN p_brand || chr(10) || p_type END AS world_rules,
  sha256('{"chapter_summary":' || to_json(CASE p_partkey % 4 WHEN 0 THEN 'about ' || p_name WHEN 1 THEN p_name WHEN 2 THEN 'no object: ' || p_name ELSE '' END)::VARCHAR || ',"character":' || CASE p_partkey % 4 WHEN 0 THEN to_json([{'name': p_name, 'description': p_type}, {'name': p_brand, 'description': ''}])::VARCHAR WHEN 1 THEN to_json([{'name': p_brand, 'description': p_type}])::VARCHAR ELSE '[]' END
    || ',"ambiguous_character_mentions":' || CASE p_partkey % 4 WHEN 0 THEN to_json([{'surface_name': p_name, 'description': p_type, 'evidence_excerpt': p_brand}])::VARCHAR ELSE '[]' END || ',"special_existence":' || CASE p_partkey % 4 WHEN 0 THEN to_json([{'name': p_brand, 'description': p_type}])::VARCHAR ELSE '[]' END
    || ',"organizations":' || CASE p_partkey % 4 WHEN 0 THEN to_json([{'name': p_brand, 'description': p_type}])::VARCHAR ELSE '[]' END || ',"world_rules":' || CASE p_partkey % 4 WHEN 0 THEN to_json([{'name': p_brand, 'description': ''}, {'name': p_type, 'description': ''}])::VARCHAR ELSE '[]' END || '}') AS payload_sha256 FROM part""")
def chapter_payloads(spark, sf_dir):
    rows = _answers(spark, sf_dir).select("p_partkey", payloads.chapter_payload(F.col("raw")).alias("p")).select("p_partkey", "p.*")
    return rows.withColumn("payload_sha256", F.sha2("payload", 256)).drop("payload")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'character[2] missing description' WHEN 1 THEN 'special_existence is not a list' ELSE 'payload is not a JSON object' END AS fault FROM part""")
def payload_faults(spark, sf_dir):
    return _answers(spark, sf_dir).select("p_partkey", payloads.payload_fault(F.col("raw")).alias("fault"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN o_custkey ELSE 7 END AS first_chapter, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey + 1 END AS last_chapter, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'own|' || o_orderpriority END AS aliases, o_orderpriority || '|x' AS roles,
  CASE WHEN o_orderkey % 2 = 0 THEN '第' || o_orderkey % 50 || '卷' ELSE 't' END AS volume_title, o_custkey % 20 > 0 AS has_evidence, o_orderpriority || ':' || o_orderstatus AS sample, 1 + o_custkey % 9 || '-' || greatest(1 + o_custkey % 9, 4) || ' s' AS timeline, 'medium' AS intensity FROM orders WHERE o_orderkey % 50 > 0
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey <> 0 THEN o_custkey ELSE 7 END, CASE WHEN o_orderkey % 3 = 0 THEN 9 ELSE o_custkey + 1 END, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'own|' || o_orderpriority END, o_orderpriority || '|x', CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 't' END, o_custkey % 20 > 0, o_orderpriority || ':' || o_orderstatus, 1 + o_custkey % 9 || '-' || greatest(1 + o_custkey % 9, 4) || ' s', 'medium' FROM orders WHERE o_orderkey % 50 = 0""")
def profile_fields(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    k, cust, status, priority = (F.col(c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    own = F.when(k % 2 == 0, F.array(status)).otherwise(F.lit(None).cast("array<string>"))
    identity = F.struct(F.lit(" i ").alias("summary"), own.alias("aliases"), F.when(k % 3 == 0, cust).otherwise(0).alias("first_chapter_index"), F.when(k % 3 == 0, F.lit("9").cast("string")).alias("last_chapter_index"))
    arc = F.array(F.struct((k % 50).alias("volume_index"), F.when(k % 2 == 1, "t").alias("volume_title"), F.array(F.lit("g"), F.lit("g")).alias("goals")))
    line = F.array(F.struct((1 + cust % 9).alias("chapter_start"), F.lit(4).alias("chapter_end"), F.lit("s").alias("summary")), F.struct(F.lit(0).cast("bigint").alias("chapter_start"), F.lit(4).alias("chapter_end"), F.lit("lost").alias("summary")))
    raw = _json(identity=identity, narrative_role=F.array(priority, F.concat(F.lit(" "), priority), F.lit("x"), F.lit("")), style_samples=F.array(F.struct(priority.alias("scene"), status.alias("quote")), F.struct(F.lit(" ").alias("scene"), status.alias("quote"))), volume_arc=arc, critical_evidence=F.array(F.struct((cust % 20).alias("chapter_index"))), emotional_relations=F.array(F.struct(status.alias("target_character"), line.alias("timeline"))))
    p = payloads.profile(raw, F.lit(7).cast("bigint"), cust + 1, F.array(F.lit("own"), priority, F.lit("own ")))
    rows = rows.select("o_orderkey", p.alias("p"))
    r = F.col("p.emotional_relations")[0]
    line = F.array_join(F.transform(r["timeline"], lambda t: F.concat(t["chapter_start"].cast("string"), F.lit("-"), t["chapter_end"].cast("string"), F.lit(" "), t["summary"])), ",")
    return rows.select("o_orderkey", F.col("p.identity.first_chapter_index").alias("first_chapter"), F.col("p.identity.last_chapter_index").alias("last_chapter"), F.array_join("p.identity.aliases", "|").alias("aliases"), F.array_join("p.narrative_role", "|").alias("roles"), F.col("p.volume_arc")[0]["volume_title"].alias("volume_title"), (F.size("p.critical_evidence") > 0).alias("has_evidence"), F.array_join(F.transform("p.style_samples", lambda s: F.concat_ws(":", s["scene"], s["quote"])), ",").alias("sample"), line.alias("timeline"), r["intensity"].alias("intensity"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'c' || l_partkey ELSE 'self' END AS target, greatest(10, CASE WHEN l_suppkey % 40 = 0 THEN 10 ELSE l_suppkey % 40 END)::BIGINT AS chapter_start,
  least(30, greatest(greatest(10, CASE WHEN l_suppkey % 40 = 0 THEN 10 ELSE l_suppkey % 40 END), l_partkey % 25 + 1))::BIGINT AS chapter_end, lower(l_returnflag) AS confidence, CASE WHEN l_partkey % 2 = 0 THEN (l_partkey % 25 + 1)::VARCHAR ELSE greatest(10, CASE WHEN l_suppkey % 40 = 0 THEN 10 ELSE l_suppkey % 40 END)::VARCHAR END AS evidence FROM lineitem""")
def roleplay_candidates(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    part, target = F.col("l_partkey"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("c"), F.col("l_partkey").cast("string"))).otherwise("self")
    evidence = F.when(part % 2 == 0, F.array(part % 25 + 1, F.lit(-1).cast("bigint"), part % 25 + 1)).otherwise(F.array(F.lit(0).cast("bigint")))
    item = F.struct(target.alias("target_character"), (F.col("l_suppkey") % 40).alias("chapter_start"), (part % 25 + 1).alias("chapter_end"), F.col("l_returnflag").alias("confidence"), evidence.alias("evidence_chapters"))
    nobody = F.struct(F.lit(" ").alias("target_character"), F.lit(1).cast("bigint").alias("chapter_start"), F.lit(1).cast("bigint").alias("chapter_end"), F.lit("").alias("confidence"), F.array(F.lit(1).cast("bigint")).alias("evidence_chapters"))
    found = payloads.relation_candidates(_json(emotional_relation_candidates=F.array(item, nobody)), F.lit(10).cast("bigint"), F.lit(30).cast("bigint"))
    rows = rows.select("l_orderkey", "l_linenumber", F.explode(found).alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.col("c.target_character").alias("target"), "c.chapter_start", "c.chapter_end", "c.confidence", F.array_join(F.transform("c.evidence_chapters", lambda x: x.cast("string")), ",").alias("evidence"))


@query("""SELECT p_partkey, p_brand AS protagonists, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'new' END AS important, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'f' END AS organizations, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'f' END AS factions, p_name AS present, p_name || '+' || p_brand || ' ' || p_type AS interaction,
  CASE WHEN p_size % 2 = 0 THEN p_type ELSE p_brand || '|技能成长: ' || p_type END AS rewards, '状态变化: ' || p_brand AS losses FROM part""")
def plot_metadata(spark, sf_dir):
    rows = tables.spread(tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size"))
    name, brand, kind, size = (F.col(c) for c in ("p_name", "p_brand", "p_type", "p_size"))
    none = F.array().cast("array<string>")
    keys = payloads.key_entities(_json(protagonists=F.array(brand, F.concat(brand, F.lit(" "))), important_characters=F.when(size % 2 == 0, F.array(kind)).otherwise(none), new_characters=F.array(F.lit("new")), organizations=F.when(size % 3 == 0, F.array(brand)).otherwise(none), factions=F.array(F.lit("f"))))
    people = payloads.present(F.to_json(F.array(F.struct(name.alias("character_name"), F.array(brand).alias("aliases")), F.struct(F.lit(" ").alias("character_name"), F.array(brand).alias("aliases")))))
    met = payloads.interactions(F.to_json(F.array(F.struct(F.array(name, brand, name).alias("characters"), kind.alias("desc")), F.struct(none.alias("characters"), F.lit("").alias("desc")))))
    told = payloads.plot_facts(_json(major_rewards=F.when(size % 2 == 0, F.array(kind)).otherwise(none)), _json(items_obtained=F.array(brand), skills_learned=F.array(kind), status_change=F.array(brand)))
    rows = rows.select("p_partkey", keys.alias("k"), people.alias("p"), met.alias("m"), told.alias("t"))
    join = lambda c, by="|": F.array_join(c, by)
    return rows.select("p_partkey", join("k.protagonists").alias("protagonists"), join("k.important_characters").alias("important"), join("k.organizations").alias("organizations"), join("k.factions_who_appear").alias("factions"), join(F.transform("p", lambda x: x["name"])).alias("present"), join(F.transform("m", lambda x: F.concat_ws(" ", join(x["participants"], "+"), x["summary"]))).alias("interaction"), join("t.major_rewards").alias("rewards"), join("t.major_losses").alias("losses"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HIT' WHEN 1 THEN 'MISS' WHEN 2 THEN 'HIT' ELSE 'MISS' END AS status, CASE event_id % 4 WHEN 0 THEN least(3, k)::VARCHAR || CASE WHEN k <> 3 THEN ',' || greatest(3, k) ELSE '' END WHEN 2 THEN least(2, k)::VARCHAR || CASE WHEN k <> 2 THEN ',' || greatest(2, k) ELSE '' END ELSE '' END AS hits,
  CASE event_id % 4 WHEN 2 THEN 'see Chapter [' || k || '] and Chapter 2' WHEN 3 THEN 'nothing' ELSE event_type END AS best, event_id % 4 IN (0, 2) AS needs_fulltext, event_id % 4 = 0 AS ability FROM (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def chapter_results(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    n, hits = F.col("event_id") % 4, F.array(F.col("k").cast("string"), F.lit("3"), F.lit("x"), F.lit("3"))
    found = _json(hit_chapters=hits, best_evidence=F.concat(F.col("event_type"), F.lit(" ")), needs_fulltext=F.lit("是"), coverage=F.struct(F.lit("yes").alias("ability")))
    missed = _json(status=F.lit("miss"), hit_chapters=F.array().cast("array<string>"), best_evidence=F.col("event_type"), needs_fulltext=F.lit(False))
    raw = F.when(n == 0, found).when(n == 1, missed).when(n == 2, F.concat(F.lit(" see Chapter ["), F.col("k").cast("string"), F.lit("] and Chapter 2"))).otherwise(F.lit("nothing"))
    rows = rows.select("event_id", payloads.chapter_result(raw, F.lit(True)).alias("r"))
    return rows.select("event_id", "r.status", F.array_join(F.transform("r.hit_chapters", lambda x: x.cast("string")), ",").alias("hits"), F.col("r.best_evidence").alias("best"), "r.needs_fulltext", F.col("r.coverage.ability").alias("ability"))
