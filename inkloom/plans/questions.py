"""Queries over questions, plans, evidence and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions.text import highlighted
from inkloom.functions.text import question as ended
from inkloom.operators import answers, evidence, planner, rounds, search
from inkloom.plans.base import CHAPTERS, INDEX, MESSAGES, query
from inkloom.plans.stories import _SPARSE, _sparse
from inkloom.sources import tables

#: Questions, {} being somebody's name, with what the rules make of each, worked out by hand: intent, source of the parts, parts, domains, first tools, route.
_FIND = "hybrid_retrieve_"
_ASKED = (
    ("他为什么叫这个名字", "identity_ability", "single", "他为什么叫这个名字为什么叫这个名字？", "characters", f"{_FIND}characters {_FIND}chapter_summaries", f"{_FIND}characters {_FIND}plots {_FIND}chapter_summaries retrieve_chapter_summaries retrieve_chapters"),
    ("{}第一次出现在哪", "first_appearance", "single", "{}第一次出现在哪？", "characters", "retrieve_entity_edge_records", "retrieve_entity_edge_records retrieve_chapter_summaries retrieve_chapters"),
    ("{}的身份是谁？他有没有兄弟", "existence_check", "explicit", "{}的身份是谁？|{}有没有兄弟？", "characters", f"{_FIND}characters {_FIND}chapter_summaries", f"{_FIND}characters {_FIND}chapter_summaries {_FIND}plots retrieve_chapter_summaries"),
    ("这个组织的规则", "general_fact", "single", "这个组织的规则？", "origanizations world_rules", f"{_FIND}origanizations {_FIND}chapter_summaries", f"{_FIND}origanizations {_FIND}world_rules {_FIND}chapter_summaries {_FIND}plots retrieve_chapter_summaries retrieve_chapters"),
    ("{}最后怎样以及原因", "causal_motivation", "explicit", "{}最后怎样？|原因？", "", f"{_FIND}plots {_FIND}chapter_summaries", f"{_FIND}plots {_FIND}chapter_summaries retrieve_chapter_summaries retrieve_chapters"),
    ("随便问问", "general_fact", "single", "随便问问？", "", f"{_FIND}chapter_summaries {_FIND}plots", f"{_FIND}chapter_summaries {_FIND}plots retrieve_chapter_summaries retrieve_chapters"),
    ("{}的完整信息", "general_fact", "implicit", "{}的身份是什么？|{}的关键经历和结局如何？", "", f"{_FIND}chapter_summaries {_FIND}plots", f"{_FIND}chapter_summaries {_FIND}plots retrieve_chapter_summaries retrieve_chapters"),
    ("厉鬼的时间线，并且它的结局？", "ending_fate", "explicit", "厉鬼的时间线？|厉鬼的结局？", "special_existences", "retrieve_entity_edge_records", "retrieve_entity_edge_records retrieve_chapter_summaries retrieve_chapters"),
    ("", "general_fact", "single", "请定位可回答该问题的章节级证据。", "", f"{_FIND}chapter_summaries {_FIND}plots", f"{_FIND}chapter_summaries {_FIND}plots retrieve_chapter_summaries retrieve_chapters"),
)
_FORMS = "forms(k, question, intent, source, parts, domains, tools, route) AS (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in row) + ")" for i, row in enumerate(_ASKED)) + f"), asked AS (SELECT c_custkey, 'N' || c_nationkey AS who, forms.* FROM customer JOIN forms ON c_custkey % {len(_ASKED)} = k)"


def _asked(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    form = F.get(F.array(*[F.lit(x[0]) for x in _ASKED]), (F.col("c_custkey") % len(_ASKED)).cast("int"))
    return rows.select("c_custkey", F.replace(form, F.lit("{}"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("question"))


@query(f"WITH {_FORMS} SELECT c_custkey, intent, source, replace(parts, '{{}}', who) AS parts, domains, tools, route FROM asked")
def question_plans(spark, sf_dir):
    q = F.col("question")
    rows = tables.spread(_asked(spark, sf_dir)).select("c_custkey", q, planner.intent(q).alias("intent"), planner.parts(q).alias("p"))
    rows = rows.withColumn("d", planner.entity_domains(q, F.col("intent")))
    text = lambda c: F.array_join(c, " ")
    return rows.select("c_custkey", "intent", "p.source", F.array_join("p.parts", "|").alias("parts"), text("d").alias("domains"), text(planner.entry_tools(F.col("intent"), F.col("d"))).alias("tools"), text(planner.route(F.col("intent"), F.col("d"))).alias("route"))


@query(f"""WITH {_FORMS}, w AS (SELECT c_custkey, intent, replace(question, '{{}}', who) AS q FROM asked), x AS (SELECT *, CASE WHEN q = '' THEN '请定位可回答该问题的章节级证据。' WHEN right(q, 1) = '？' THEN q ELSE q || '？' END AS nq, regexp_extract_all(q, '[一-鿿A-Za-z0-9_]+') AS ks FROM w),
y AS (SELECT *, rtrim(nq, '？?。') AS b, CASE WHEN len(ks) > 0 THEN array_to_string(ks, ' ') ELSE trim(nq, '？?') END AS stack FROM x)
SELECT c_custkey, stack AS entity_query, stack || CASE intent WHEN 'causal_motivation' THEN ' 原因 动机 故意 导致' WHEN 'ending_fate' THEN ' 结局 最后 下场 最终' WHEN 'identity_ability' THEN ' 身份 能力 背景' ELSE '' END AS plot_query,
  CASE intent WHEN 'identity_ability' THEN b || ' 请确认身份定义、能力信息和章节依据。' WHEN 'first_appearance' THEN b || ' 请确认首次出现章节和当时情境。' WHEN 'existence_check' THEN b || ' 请确认是否真实出现，并给出最早可定位章节。' WHEN 'causal_motivation' THEN b || ' 请确认直接原因、动机链条和关键章节。' WHEN 'ending_fate' THEN b || ' 请确认最终状态、关键转折和章节依据。' ELSE nq END AS chapter_query,
  CASE intent WHEN 'identity_ability' THEN 'reasoning' WHEN 'causal_motivation' THEN 'reasoning' WHEN 'ending_fate' THEN 'timeline' ELSE 'fact' END AS answer_mode, array_to_string(ks[1:4], '|') AS hints,
  CASE WHEN regexp_matches(q, '身份|是谁|背景|为什么叫|为何叫|称号') THEN '身份' WHEN regexp_matches(q, '结局|最后|下场') THEN '结局' WHEN regexp_matches(q, '第一次|首次') THEN '首次出场' ELSE '问题' END AS label FROM y""")
def question_rewrites(spark, sf_dir):
    q = F.col("question")
    rows = _asked(spark, sf_dir).withColumn("intent", planner.intent(q))
    r = planner.rewrites(q, F.col("intent"))
    rows = rows.select("c_custkey", r.alias("r"), planner.label(q, F.col("intent")).alias("label"))
    return rows.select("c_custkey", "r.entity_query", "r.plot_query", "r.chapter_query", "r.answer_mode", F.array_join("r.entity_hints", "|").alias("hints"), "label")




@query("""WITH k AS (SELECT o_orderkey, ['existence_check', 'first_appearance', 'identity_ability', 'ending_fate', 'general_fact', 'causal_motivation', 'timeline_evolution', 'quote_micro_detail'] AS names, [4, 5, 6, 6, 6, 7, 8, 8] AS costs, o_orderkey % 3 + 1 AS n, o_custkey FROM orders),
c AS (SELECT o_orderkey, n, o_custkey, list_transform(range(0, n), lambda i: costs[(o_orderkey + i * 3) % 8 + 1]) AS each, list_transform(range(0, n), lambda i: names[(o_orderkey + i * 3) % 8 + 1]) AS kinds FROM k)
SELECT o_orderkey, least(14, greatest(greatest([8, 10, 12][n], least(14, list_sum(each) - least(4, 2 * (n - 1)) + least(3, n))), greatest(4, least(14, o_custkey % 20))))::INT AS tool_calls,
  least(3, greatest(CASE WHEN list_contains(kinds, 'timeline_evolution') OR list_contains(kinds, 'quote_micro_detail') THEN 3 ELSE 2 END, greatest(1, least(3, o_custkey % 5))))::INT AS fulltext_windows FROM c""")
def search_budgets(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "orders", "o_orderkey", "o_custkey")
    kinds = F.array(*map(F.lit, planner.TOOL_CALLS))
    asked = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("o_orderkey") % 3), lambda i: F.get(kinds, ((F.col("o_orderkey") + i * 3) % 8).cast("int")))
    return rows.select("o_orderkey", planner.budget(asked, (F.col("o_custkey") % 20).cast("int"), (F.col("o_custkey") % 5).cast("int")).alias("b")).select("o_orderkey", "b.*")


@query("""WITH s AS (SELECT event_id, event_id % 6 AS results, (event_id % 10) / 10.0 AS conf, event_id % 7 = 0 AS rr, event_id % 11 = 0 AS em, event_id % 13 = 0 AS rep, event_id % 3 > 0 AS nc, event_id % 8 AS calls, event_id % 4 AS ft, CASE WHEN event_id % 2 = 0 THEN 'hybrid_retrieve_chapter_summaries' ELSE '' END AS last FROM events),
f AS (SELECT *, results = 0 OR conf < 0.45 AS low FROM s)
SELECT event_id, concat_ws(',', CASE WHEN em THEN 'embedding_api_unavailable' END, CASE WHEN rep THEN 'loop_risk' END, CASE WHEN low THEN 'hybrid_no_hit_or_low_confidence' END, CASE WHEN NOT nc THEN 'no_new_coordinates' END, CASE WHEN rr THEN 'rerank_unavailable' END) AS failed,
  CASE WHEN rep THEN 'switch_level' WHEN calls >= 6 OR ft >= 2 THEN 'finalize_answer' WHEN em THEN 'retrieve_chapter_summaries' WHEN low THEN CASE WHEN last = 'hybrid_retrieve_chapter_summaries' THEN 'retrieve_chapter_summaries' ELSE 'hybrid_retrieve_chapter_summaries' END WHEN NOT nc AND calls >= 3 THEN 'finalize_answer' ELSE 'hybrid_retrieve_plots' END AS next_tool,
  NOT rep AND (calls >= 6 OR ft >= 2 OR (NOT em AND NOT low AND NOT nc AND calls >= 3)) AS finalize FROM f""")
def route_decisions(spark, sf_dir):
    n = F.col("event_id")
    state = F.struct((n % 6).alias("results"), ((n % 10) / 10).alias("confidence"), (n % 7 == 0).alias("rerank_failed"), (n % 11 == 0).alias("embedding_failed"), (n % 13 == 0).alias("repeated"), (n % 3 > 0).alias("new_coordinates"), (n % 8).alias("calls"), (n % 4).alias("fulltext_calls"), F.when(n % 2 == 0, planner.FIND_SUMMARIES).otherwise("").alias("last_tool"))
    rows = tables.table(spark, sf_dir, "events", "event_id").withColumn("state", state)
    step = planner.next_step(F.array(*map(F.lit, planner.ROUTES["causal_motivation"])), F.col("state"))
    return rows.select("event_id", F.array_join(planner.fallbacks(F.col("state")), ",").alias("failed"), step.alias("s")).select("event_id", "failed", "s.*")


_SCORES = """sc AS (SELECT p_partkey, p_size % 11 AS n, p_partkey % 5 AS top, 'red ' || lower(p_brand) AS q, lower(p_brand || ' ' || p_type) AS t, p_retailprice AS a, CASE WHEN p_size % 4 > 0 THEN p_retailprice * (1 - (p_partkey % 40) / 100.0) END AS b, CASE WHEN p_size % 3 > 0 THEN p_retailprice * 0.7 END AS c FROM part),
cv AS (SELECT *, (CASE WHEN contains(t, 'red') THEN 1 ELSE 0 END + list_sum(list_transform(regexp_extract_all(substr(q, 5), '[a-z0-9_]+'), lambda w: CASE WHEN contains(t, w) THEN 1 ELSE 0 END))) / (1 + len(regexp_extract_all(substr(q, 5), '[a-z0-9_]+'))) AS cov, CASE WHEN b IS NOT NULL THEN greatest(0, (a - b) / abs(a)) END AS near, CASE WHEN c IS NOT NULL THEN greatest(0, (a - c) / abs(a)) END AS far FROM sc)"""


def _scored(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    price, size = F.col("p_retailprice"), F.col("p_size")
    return rows.select("p_partkey", (size % 11).alias("n"), (F.col("p_partkey") % 5).alias("top"), F.concat(F.lit("red "), F.lower("p_brand")).alias("q"), F.concat_ws(" ", "p_brand", "p_type").alias("t"), price.alias("a"), F.when(size % 4 > 0, price * (1 - (F.col("p_partkey") % 40) / 100)).alias("b"), F.when(size % 3 > 0, price * 0.7).alias("c"))


@query(f"""WITH {_SCORES} SELECT p_partkey, CASE WHEN n = 0 THEN 'no_candidates' WHEN n = 1 THEN 'skip_single_candidate' WHEN n <= 3 AND top <= 3 AND cov >= 0.6 THEN 'skip_rerank_small_precise_set' WHEN n <= 5 AND cov >= 0.7 AND (near IS NULL OR near >= 0.18) THEN 'skip_rerank_high_coverage_gap' ELSE 'rerank_needed' END AS reason FROM cv""")
def rerank_skips(spark, sf_dir):
    c = {k: F.col(k) for k in ("q", "n", "t", "a", "b", "top")}
    return _scored(spark, sf_dir).select("p_partkey", search.skips_rerank(c["q"], c["n"], c["t"], c["a"], c["b"], c["top"])["reason"].alias("reason"))


@query(f"""WITH {_SCORES} SELECT p_partkey, CASE WHEN n = 0 THEN 'empty_candidates' WHEN n = 1 THEN 'heuristic_skip_single_candidate' WHEN n <= 3 AND cov >= 0.6 AND (near IS NULL OR near >= 0.2) THEN 'heuristic_skip_precise_small_set' WHEN cov >= 0.6 AND near >= 0.15 AND (far IS NULL OR far >= 0.2) THEN 'heuristic_skip_high_confidence_gap' WHEN n >= 8 THEN 'auto_large_candidate_set' ELSE 'auto_ambiguous_candidates' END AS reason FROM cv""")
def filter_rules(spark, sf_dir):
    return _scored(spark, sf_dir).select("p_partkey", search.wants_filter(*map(F.col, "qntabc"))["reason"].alias("reason"))


@query("""SELECT p_partkey, terms, round(CASE WHEN len(b) = 0 THEN 0 ELSE len(list_intersect(a, b)) / len(b) END, 6) AS overlap FROM (SELECT p_partkey, array_to_string(list_filter(list_distinct_in, lambda x: true)[1:6], '|') AS terms, list_distinct(string_split(replace(p_brand, ' ', ''), '')) AS a, list_distinct(string_split(replace(p_type, ' ', ''), '')) AS b
FROM (SELECT *, list_filter(list_transform(l, lambda x, i: CASE WHEN list_position(list_transform(l, lambda y: lower(y)), lower(x)) = i THEN x END), lambda x: x IS NOT NULL) AS list_distinct_in FROM (SELECT p_partkey, p_brand, p_type, list_filter(string_split_regex(p_name || '，' || p_type || ' 章节 ' || p_brand, '[\\s，,。；;：:、!?？（）()<>《》【】\\[\\]\\\\-]+'), lambda x: length(x) BETWEEN 2 AND 16 AND x <> '章节') AS l FROM part)))""")
def refinement_terms(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    text = F.concat("p_name", F.lit("，"), "p_type", F.lit(" 章节 "), "p_brand")
    return rows.select("p_partkey", F.array_join(answers.refinement_terms(text), "|").alias("terms"), F.round(answers.theme_overlap(F.col("p_brand"), F.col("p_type")), 6).alias("overlap"))


_RANKED = f"{CHAPTERS}, {_SPARSE}, ev AS (SELECT query_id, sparse_rank AS rank, CASE WHEN sparse_rank % 3 = 0 THEN 'chapter_summaries' ELSE 'chapters' END AS source, book_id, chapter_index, content, chapter_summary, sparse_score AS score FROM s JOIN chapters ON doc_id = id)"


def _ranked(spark, sf_dir):
    """What every benchmark passage finds, as evidence in order."""
    rows = tables.chapters(spark, sf_dir).select("doc_id", "book_id", "chapter_index", "content", "chapter_summary")
    hits = _sparse(spark, sf_dir).join(rows, F.col("id") == F.col("doc_id"))
    source = F.when(F.col("sparse_rank") % 3 == 0, "chapter_summaries").otherwise("chapters")
    return hits.select("query_id", F.col("sparse_rank").cast("bigint").alias("rank"), source.alias("source"), "book_id", "chapter_index", "content", "chapter_summary", F.round("sparse_score", 6).alias("score"))


_CONFIRMED = f"""{_RANKED}, g AS (SELECT query_id, book_id, chapter_index, content, CASE query_id % 4 WHEN 0 THEN 'existence_check' WHEN 1 THEN 'timeline_evolution' ELSE 'general_fact' END AS intent, CASE WHEN rank % 5 = 0 THEN '未提及' ELSE chapter_summary END AS snippet, score, rank FROM ev WHERE source = 'chapters'),
ok AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM g WHERE snippet <> '' AND NOT contains(snippet, '未提及') QUALIFY nth <= CASE query_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 2 END)"""


def _confirmed(spark, sf_dir):
    k = F.col("query_id") % 4
    intent = F.when(k == 0, "existence_check").when(k == 1, "timeline_evolution").otherwise("general_fact")
    rows = _ranked(spark, sf_dir).select(F.col("query_id").alias("subquery_id"), "book_id", intent.alias("intent"), "source", "chapter_index", F.when(F.col("rank") % 5 == 0, "未提及").otherwise(F.col("chapter_summary")).alias("snippet"), "score", "rank")
    return answers.confirmed(rows, tables.contents(spark, sf_dir).select("book_id", "chapter_index", "content"))


@query(f"WITH {_CONFIRMED} SELECT query_id AS subquery_id, chapter_index, snippet AS claim, sha256(CASE WHEN trim(content) <> '' THEN trim(content) ELSE snippet END) AS excerpt_sha256, score AS confidence, nth FROM ok")
def confirmed_chapters(spark, sf_dir):
    return _confirmed(spark, sf_dir).withColumn("excerpt_sha256", F.sha2("excerpt", 256)).drop("excerpt")


@query(f"""WITH {_CONFIRMED}, f AS (SELECT *, CASE WHEN rank % 3 = 1 THEN (chapter_index - 1) // 5 + 1 END AS plot_id, CASE WHEN rank % 4 = 1 THEN (chapter_index - 1) // 20 + 1 END AS volume_id FROM ev),
h AS (SELECT query_id, (list(chapter_index ORDER BY rank))[:8] AS c, coalesce((list(plot_id ORDER BY rank) FILTER (WHERE plot_id > 0))[:8], []) AS p, coalesce((list(volume_id ORDER BY rank) FILTER (WHERE volume_id > 0))[:8], []) AS v, (list_sort(list(DISTINCT book_id)))[:8] AS ids, count(DISTINCT book_id) = 1 AS applied FROM f GROUP BY 1),
e AS (SELECT query_id, string_agg(source || ' ' || chapter_index || ' ' || coalesce(plot_id::VARCHAR, '-') || ' ' || coalesce(volume_id::VARCHAR, '-') || ' ' || split_part(chapter_summary, ' ', 1) || ' ' || left(chapter_summary, 320), '; ' ORDER BY rank) AS evidence FROM f WHERE rank <= 4 GROUP BY 1),
k AS (SELECT query_id, string_agg(query_id || ' ' || chapter_index || ' ' || snippet || ' ' || sha256(CASE WHEN trim(content) <> '' THEN trim(content) ELSE snippet END), '; ' ORDER BY nth) AS confirmed FROM ok GROUP BY 1)
SELECT h.query_id, evidence, coalesce(confirmed, '') AS confirmed, array_to_string(c, ',') AS chapter_hits, array_to_string(p, ',') AS plot_hits, array_to_string(v, ',') AS volume_hits, applied, array_to_string(ids, ',') AS source_ids FROM h JOIN e USING (query_id) LEFT JOIN k USING (query_id)""")
def search_packets(spark, sf_dir):
    """What every benchmark passage's search hands on: evidence, confirmed chapters, places, and the books that it was found in as its grounding."""
    ranked = _ranked(spark, sf_dir)
    at, n = F.col("chapter_index"), F.col("rank")
    rows = ranked.select("query_id", n, "source", "book_id", at, F.when(n % 3 == 1, F.floor((at - 1) / 5) + 1).alias("plot_id"), F.when(n % 4 == 1, F.floor((at - 1) / 20) + 1).alias("volume_id"), F.substring_index("chapter_summary", " ", 1).alias("source_name"), F.col("chapter_summary").alias("snippet"), "score")
    sure = _confirmed(spark, sf_dir).select(F.col("subquery_id").alias("query_id"), "subquery_id", F.lit("").alias("label"), "chapter_index", F.lit("").alias("source_name"), "claim", F.sha2("excerpt", 256).alias("excerpt"), "confidence", "nth")
    ids = F.array_sort(F.collect_set("book_id"))
    homes = rows.groupBy("query_id").agg(ids.alias("source_ids"), (F.count_distinct("book_id") == 1).alias("applied")).select("query_id", "applied", F.lit("books").alias("entity_type"), "source_ids", F.lit("").alias("reason"), F.transform("source_ids", lambda x: x.cast("string")).alias("selected"))
    found = answers.packets(rows, sure, homes)
    text = lambda x: F.coalesce(x.cast("string"), F.lit("-"))
    shown = F.transform("evidence", lambda e: F.concat_ws(" ", e["source"], text(e["chapter_index"]), text(e["plot_id"]), text(e["volume_id"]), e["source_name"], e["snippet"]))
    kept = F.transform("confirmed", lambda c: F.concat_ws(" ", text(c["subquery_id"]), text(c["chapter_index"]), c["claim"], c["excerpt"]))
    listed = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("query_id", F.array_join(shown, "; ").alias("evidence"), F.coalesce(F.array_join(kept, "; "), F.lit("")).alias("confirmed"), *[listed(c).alias(c) for c in ("chapter_hits", "plot_hits", "volume_hits")], "grounding.applied", listed("grounding.source_ids").alias("source_ids"))


_SAFE = lambda c: f"replace(replace(replace(replace(replace(replace(trim({c}, chr(10) || chr(13) || chr(9) || ' '), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#x27;'), chr(10), '<br>')"


@query(f"""WITH {_CONFIRMED}, x AS (SELECT query_id, chapter_index, {_SAFE("CASE WHEN trim(content) <> '' THEN trim(content) ELSE snippet END")} AS e, {_SAFE("split_part(snippet, '.', 1)")} AS c FROM ok)
SELECT query_id, chapter_index, sha256(CASE WHEN e = '' OR c = '' THEN e WHEN contains(e, c) THEN left(e, instr(e, c) - 1) || '<span style="color:#67e8f9;font-weight:700;background:rgba(8,145,178,0.16);padding:0 0.14rem;border-radius:0.22rem;">' || c || '</span>' || substr(e, instr(e, c) + length(c))
  ELSE '<div style="color:#67e8f9;font-weight:700;margin-bottom:0.45rem;">' || c || '</div><div>' || e || '</div>' END) AS html_sha256 FROM x""")
def highlighted_excerpts(spark, sf_dir):
    """The excerpts of confirmed chapters as HTML, with the claim's first sentence marked."""
    found = _confirmed(spark, sf_dir)
    return found.select(F.col("subquery_id").alias("query_id"), "chapter_index", F.sha2(highlighted(F.col("excerpt"), F.substring_index("claim", ".", 1)), 256).alias("html_sha256"))


@query(f"""WITH {_CONFIRMED}, se AS (SELECT query_id // 3 AS query_id, query_id AS subquery_id, string_agg('Chapter ' || chapter_index, ', ' ORDER BY nth) AS cited, list(snippet ORDER BY nth) AS sn, query_id % 5 > 0 AS resolved FROM ok GROUP BY ok.query_id),
tx AS (SELECT query_id, subquery_id, resolved, 'L' || subquery_id || '：' || chr(10) || CASE WHEN resolved THEN sn[1] ELSE '证据不足，暂时无法稳定回答这一子问题。' END || CASE WHEN NOT resolved THEN chr(10) || '补充依据：' || sn[1] WHEN len(sn) > 1 THEN chr(10) || '补充依据：' || sn[2] ELSE '' END || chr(10) || '定位：' || cited || CASE WHEN NOT resolved THEN chr(10) || '状态：证据不足' ELSE '' END AS text FROM se),
an AS (SELECT query_id, bool_or(resolved) AS any_, bool_and(resolved) AS all_, coalesce(string_agg('L' || subquery_id, '、' ORDER BY subquery_id) FILTER (WHERE resolved), '') AS labels, string_agg(text, chr(10) || chr(10) ORDER BY subquery_id) AS body FROM tx GROUP BY 1)
SELECT query_id, CASE WHEN NOT any_ THEN '未能获得足够稳定的章节级证据来完整回答该问题。' WHEN NOT all_ THEN '已就' || labels || '获得阶段性结论，但仍有部分子问题证据不足。' ELSE '已完成对' || labels || '的检索与证据整合。' END AS summary,
  sha256('总述：' || CASE WHEN NOT any_ THEN '未能获得足够稳定的章节级证据来完整回答该问题。' WHEN NOT all_ THEN '已就' || labels || '获得阶段性结论，但仍有部分子问题证据不足。' ELSE '已完成对' || labels || '的检索与证据整合。' END || chr(10) || chr(10) || body) AS answer_sha256 FROM an""")
def composed_answers(spark, sf_dir):
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("nth", c.alias("x")))), lambda s: s["x"])
    parts = _confirmed(spark, sf_dir).groupBy("subquery_id").agg(listed(F.col("claim")).alias("snippets"), listed(F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"))).alias("citations"))
    parts = parts.select(F.floor(F.col("subquery_id") / 3).alias("query_id"), "subquery_id", F.concat(F.lit("L"), F.col("subquery_id").cast("string")).alias("label"), (F.col("subquery_id") % 5 > 0).alias("resolved"), "snippets", "citations")
    return answers.answers(answers.sections(parts)).select("query_id", "summary", F.sha2("answer", 256).alias("answer_sha256"))


@query(f"""WITH {_RANKED}, w AS (SELECT query_id, min(chapter_index) AS low, min(chapter_index) + 4 AS high FROM ev WHERE query_id % 2 = 0 GROUP BY 1)
SELECT ev.query_id AS subquery_id, source, chapter_index, rank, negative FROM (SELECT *, regexp_matches(chapter_summary, '未提及|未发现|无相关|没有提及|无法确认|证据不足|不支持|未在本次|未找到') OR trim(chapter_summary) = '' AS negative FROM ev) ev LEFT JOIN w USING (query_id) WHERE NOT coalesce(source = 'chapter_summaries' AND chapter_index BETWEEN low AND high, false)""")
def window_evidence(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select(F.col("query_id").alias("subquery_id"), "source", "chapter_index", "rank", evidence.negative(F.col("chapter_summary")).alias("negative"))
    windows = rows.where("subquery_id % 2 = 0").groupBy("subquery_id").agg(F.min("chapter_index").alias("low"), (F.min("chapter_index") + 4).alias("high"))
    return evidence.without_summaries(rows, windows)


@query(f"""WITH {_RANKED}, r AS (SELECT query_id, chapter_index, row_number() OVER (PARTITION BY query_id ORDER BY chapter_index DESC) AS nth FROM (SELECT query_id, max(chapter_index) AS chapter_index FROM ev GROUP BY query_id, book_id))
SELECT query_id, chapter_index, nth, 'entity_edge_last' AS source, round(greatest(0.72, 0.86 - (nth - 1) * 0.04), 6) AS score FROM (SELECT query_id, chapter_index, row_number() OVER (PARTITION BY query_id ORDER BY chapter_index DESC) AS nth FROM (SELECT DISTINCT query_id, chapter_index FROM r))""")
def edge_evidence(spark, sf_dir):
    rows = _ranked(spark, sf_dir).groupBy("query_id", "book_id").agg(F.max("chapter_index").alias("chapter_index")).select("query_id", "chapter_index").distinct()
    return answers.edge_scores(rows, "last")


@query(f"""WITH {_RANKED}, d AS (SELECT query_id, string_agg('chapter_index: ' || chapter_index || ' here', ', ' ORDER BY rank) AS text FROM ev GROUP BY 1), h AS (SELECT query_id, list(chapter_index ORDER BY rank) AS hits FROM ev WHERE rank <= 3 GROUP BY 1)
SELECT query_id, 'chapter_directory' AS source, chapter_index, length(left(text, 320)) AS chars, 0.7 AS score FROM d JOIN (SELECT DISTINCT query_id, chapter_index FROM ev) USING (query_id) UNION ALL SELECT query_id, 'chapters', unnest(hits), 4, 0.95 FROM h""")
def tool_evidence(spark, sf_dir):
    rows = _ranked(spark, sf_dir)
    line = F.struct("rank", F.concat(F.lit("chapter_index: "), F.col("chapter_index").cast("string"), F.lit(" here")).alias("x"))
    listings = rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda s: s["x"]), ", ").alias("text"))
    hits = rows.where("rank <= 3").groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "chapter_index"))), lambda s: s["chapter_index"]).alias("hit_chapters"), F.lit(" best ").alias("best_evidence"))
    found = answers.directory_evidence(listings).unionByName(answers.structured_evidence(hits, "chapters"))
    return found.select("query_id", "source", "chapter_index", F.length("snippet").cast("bigint").alias("chars"), "score")


@query(f"""WITH {INDEX}, e AS (SELECT book_id, CASE WHEN word_count % 2 = 0 THEN chapter_index END AS chapter_index, CASE WHEN word_count % 3 = 0 THEN plot_id END AS plot_id, CASE WHEN word_count % 5 = 0 THEN volume_id END AS volume_id FROM ci)
SELECT DISTINCT book_id, 'chapter' AS kind, chapter_index AS place FROM e WHERE chapter_index > 0 UNION ALL SELECT DISTINCT book_id, 'plot', plot_id FROM e WHERE plot_id > 0 UNION ALL SELECT DISTINCT book_id, 'volume', volume_id FROM e WHERE volume_id > 0""")
def coordinate_sets(spark, sf_dir):
    n = F.col("word_count")
    rows = tables.with_hierarchy(tables.word_counts(spark, sf_dir).select("book_id", "chapter_index", "word_count"))
    rows = rows.select("book_id", F.when(n % 2 == 0, F.col("chapter_index")).alias("chapter_index"), F.when(n % 3 == 0, F.col("plot_id")).alias("plot_id"), F.when(n % 5 == 0, F.col("volume_id")).alias("volume_id"))
    return evidence.coordinates(rows, "book_id")


_KINDS = ("first_appearance", "causal_motivation", "general_fact", "timeline_evolution", "quote_micro_detail")
_PARTS = "pt AS (SELECT event_id, ['first_appearance', 'causal_motivation', 'general_fact', 'timeline_evolution', 'quote_micro_detail'][event_id % 5 + 1] AS intent, CASE WHEN event_id % 3 > 0 THEN user_id % 60 + 1 END AS c, CASE WHEN event_id % 3 = 0 THEN event_id % 40 + 1 END AS a, CASE WHEN event_id % 6 = 0 THEN event_id % 40 + 9 END AS z, (event_id % 100) / 100.0 AS sure, event_id % 9 AS n FROM events)"


@query(f"""WITH {_PARTS} SELECT event_id, CASE WHEN c > 0 THEN greatest(1, c - w) WHEN a > 0 AND z > 0 THEN a ELSE 5 END AS window_start, CASE WHEN c > 0 THEN least(greatest(greatest(1, c - w), c + w), greatest(1, c - w) + 2) WHEN a > 0 AND z > 0 THEN least(z, a + 2) ELSE 7 END AS window_end,
  intent IN ('first_appearance', 'quote_micro_detail') OR event_type = 'purchase原文' OR n = 0 OR (intent IN ('causal_motivation', 'timeline_evolution') AND sure < 0.82) OR sure < 0.72 AS fulltext, coalesce(intent IN ('first_appearance', 'quote_micro_detail') AND n BETWEEN 1 AND 3, false) AS past_summaries,
  CASE WHEN event_id % 8 = 0 THEN 'already_resolved' WHEN event_id % 7 = 0 THEN 'global_tool_budget_exhausted' WHEN n = 0 THEN 'no_chapter_evidence' WHEN sure < 0.78 THEN 'low_confidence' WHEN event_id % 2 = 0 THEN 'conflicting_evidence' ELSE 'not_needed' END AS recovery
FROM (SELECT pt.*, event_type, CASE WHEN intent IN ('timeline_evolution', 'causal_motivation') THEN 1 ELSE 0 END AS w FROM pt JOIN events USING (event_id))""")
def reading_rules(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events", "event_id", "user_id", "event_type")
    k = F.col("event_id")
    rows = rows.select("event_id", "event_type", F.get(F.array(*map(F.lit, _KINDS)), (k % 5).cast("int")).alias("intent"), F.when(k % 3 > 0, F.col("user_id") % 60 + 1).alias("chapter_index"), F.when(k % 3 == 0, k % 40 + 1).alias("start_chapter"), F.when(k % 6 == 0, k % 40 + 9).alias("end_chapter"), F.lit(5).cast("bigint").alias("low"), F.lit(7).cast("bigint").alias("high"), ((k % 100) / 100).alias("sure"), (k % 9).alias("n"))
    rows = answers.validation_windows(rows)
    left = F.when(k % 7 == 0, 0).otherwise(3)
    return rows.select("event_id", "window_start", "window_end", answers.needs_fulltext(F.col("intent"), F.col("n") == 0, F.col("sure"), F.col("event_type")).alias("fulltext"), answers.skips_summaries(F.col("intent"), F.lit(1), F.col("n")).alias("past_summaries"), answers.recovery(k % 8 == 0, F.col("n"), F.col("sure"), k % 2 == 0, left, F.lit(1))["reason"].alias("recovery"))


_CHAT = f"{MESSAGES}, ch AS (SELECT session_id, message_id, role, CASE message_id % 5 WHEN 2 THEN '请重新搜索' WHEN 4 THEN '你好，谁？' ELSE trim(content) END AS content FROM messages)"


@query(f"""WITH {_CHAT}, u AS (SELECT *, length(regexp_replace(content, '\\s+', '', 'g')) BETWEEN 1 AND 32 AND contains(content, '重新搜索') AS again FROM ch WHERE role = 'user'),
q AS (SELECT *, last_value(CASE WHEN content <> '' AND NOT again THEN content END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY message_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM u)
SELECT session_id, message_id, sha256(CASE WHEN again THEN coalesce(l, content) ELSE content END) AS question_sha256, content <> '' AND NOT contains(content, '你好') AND (regexp_matches(content, '[？?]$')) AS searched FROM q""")
def chat_routing(spark, sf_dir):
    rows = tables.messages(spark, sf_dir)
    k = F.col("message_id") % 5
    rows = rows.withColumn("content", F.when(k == 2, "请重新搜索").when(k == 4, "你好，谁？").otherwise(F.trim("content")))
    asked = answers.chat_questions(rows).select(F.col("session_id").alias("s"), F.col("message_id").alias("m"), "question")
    both = rows.where("role = 'user'").join(asked, (F.col("session_id") == F.col("s")) & (F.col("message_id") == F.col("m")))
    return both.select("session_id", "message_id", F.sha2("question", 256).alias("question_sha256"), answers.searches(F.col("content")).alias("searched"))


@query("""WITH x AS (SELECT a.n_nationkey AS k, b.n_name AS scene, r_name AS quote, CASE WHEN contains(b.n_name, left(a.n_name, 2)) OR contains(b.n_name, 'A') THEN 2 ELSE 0 END + CASE WHEN contains(r_name, left(a.n_name, 2)) OR contains(r_name, 'A') THEN 1 ELSE 0 END AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey JOIN region ON b.n_regionkey = r_regionkey)
SELECT k AS n_nationkey, string_agg(scene || ':' || quote, '; ' ORDER BY w DESC, scene, quote) AS samples FROM (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY w DESC, scene, quote) <= 4) GROUP BY k""")
def style_samples(spark, sf_dir):
    """A nation's beginning as a question to the samples of its region."""
    n, r = tables.table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey"), tables.table(spark, sf_dir, "region", "r_regionkey", "r_name")
    samples = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("scene"), F.col("r_name").alias("quote"))).alias("samples"))
    found = answers.style_samples(F.concat(F.substring("n_name", 1, 2), F.lit(" A")), F.col("samples"))
    return n.join(samples, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["scene"], s["quote"])), "; ").alias("samples"))


@query(f"""WITH {_FORMS}, q AS (SELECT c_custkey, replace(question, '{{}}', who) AS q FROM asked) SELECT c_custkey, CASE WHEN q = '' THEN '' WHEN right(q, 1) IN ('？', '?', '。') THEN q ELSE q || '？' END AS question FROM q""")
def ended_questions(spark, sf_dir):
    return _asked(spark, sf_dir).select("c_custkey", ended(F.col("question")).alias("question"))


_INTENTS = tuple(planner.TOOL_CALLS)


def round_parts(spark, sf_dir):
    """(parts, hits) of the rounds: three benchmark passages make a question; a part is asked to the book of its best hit, and the other hits of that book are its first evidence."""
    places = tables.chapter_index(spark, sf_dir).select("doc_id", "book_id", "chapter_index")
    found = _sparse(spark, sf_dir).join(places, F.col("id") == F.col("doc_id"))
    home = found.groupBy("query_id").agg(F.min_by("book_id", "sparse_rank").alias("_book"))
    hits = found.join(home, "query_id").where("book_id = _book").select(F.col("query_id").alias("part_id"), F.lit("plots").alias("source"), "chapter_index", (F.round("sparse_score", 6) * evidence.WEIGHTS["plots"]).alias("score"))
    n = F.col("item_id")
    kind = lambda at: F.get(F.array(*map(F.lit, _INTENTS)), (at % len(_INTENTS)).cast("int"))
    asked = tables.table(spark, sf_dir, "benchmark", "item_id", "text").join(home, n == F.col("query_id")).drop("query_id")
    question = F.floor(n / 3)
    budget = planner.budget(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: kind(question * 3 + i)), F.lit(4), F.lit(1))
    parts = asked.select(question.alias("query_id"), n.alias("part_id"), (n % 3).alias("priority"), (n % 2 == 0).alias("explicit"), F.col("_book").alias("book_id"), kind(n).alias("intent"), F.col("text").alias("question"), (budget["tool_calls"] - 3).cast("bigint").alias("tool_calls"), budget["fulltext_windows"].cast("bigint").alias("fulltext_windows"))
    return parts, hits


@query()
def research_rounds(spark, sf_dir):
    """Every benchmark passage as a part of a question, searched in rounds until it is resolved or its question's budget is spent; held against a plain loop in the tests."""
    parts, hits = round_parts(spark, sf_dir)
    chapters = tables.chapters(spark, sf_dir).select("book_id", "chapter_index", "chapter_summary", "content")
    return rounds.research_rounds(parts, hits, chapters, search.STOPWORDS)
