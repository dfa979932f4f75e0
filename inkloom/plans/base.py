"""Registration of queries beside their SQL, and the SQL of the derived tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from inkloom.sources.tables import scope

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

BOOKS = "books AS (SELECT source, row_number() OVER (ORDER BY source NULLS LAST) AS book_id FROM (SELECT DISTINCT source FROM documents))"
CHAPTERS = rf"""{BOOKS}, sentences AS (SELECT doc_id, source, coalesce(text, '') AS content, regexp_extract_all(coalesce(text, ''), '[^.!?。！？]+[.!?。！？]*') AS s FROM documents),
edges AS (SELECT *, trim(left(trim(coalesce(s[1], '')), 120)) AS a, trim(left(trim(CASE WHEN len(s) > 0 THEN list_reduce(s, lambda x, y: CASE WHEN length(y) > length(x) THEN y ELSE x END) ELSE '' END), 120)) AS b, trim(left(trim(coalesce(s[-1], '')), 120)) AS c FROM sentences),
chapters AS (
  SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS chapter_index, doc_id, content,
    trim(a || CASE WHEN b NOT IN (a, '') THEN ' ' || b ELSE '' END || CASE WHEN c NOT IN (a, b, '') THEN ' ' || c ELSE '' END) AS chapter_summary, length(regexp_replace(content, '\s+', '', 'g'))::BIGINT AS word_count
  FROM edges e JOIN books ON e.source IS NOT DISTINCT FROM books.source)"""
INDEX = CHAPTERS + """, ci AS (
  SELECT *, ((chapter_index - 1) // 5 + 1)::BIGINT AS plot_id, (((chapter_index - 1) // 5) // 4 + 1)::BIGINT AS volume_id FROM chapters)"""
PLOTS = INDEX + """, plots AS (
  SELECT book_id, plot_id, min(volume_id) AS volume_id, min(chapter_index) AS start_chapter, max(chapter_index) AS end_chapter, count(*) AS chapter_count,
    string_agg(chapter_index || ': ' || chapter_summary, chr(10) ORDER BY chapter_index) AS chapter_data
  FROM ci GROUP BY book_id, plot_id)"""
VOLUMES = PLOTS + """, volumes AS (
  SELECT book_id, volume_id, min(plot_id) AS start_plot, max(plot_id) AS end_plot, arg_min(start_chapter, plot_id) AS start_chapter, arg_max(end_chapter, plot_id) AS end_chapter, count(*) AS plot_count
  FROM plots GROUP BY book_id, volume_id)"""
MESSAGES = "messages AS (SELECT conv_id AS session_id, turn AS message_id, role, text AS content, greatest(1, length(text) // 4)::BIGINT AS token_count FROM conversations)"
EVENTS = """rel AS (
  SELECT s_nationkey::BIGINT AS source_id, c_nationkey::BIGINT AS target_id, ((year(l_shipdate) - 1992) * 12 + month(l_shipdate))::BIGINT AS chapter_start,
    ((year(l_shipdate) - 1992) * 12 + month(l_shipdate) + l_linenumber % 2)::BIGINT AS chapter_end, l_linestatus AS relation_type,
    CASE l_returnflag WHEN 'R' THEN 'negative' WHEN 'A' THEN 'positive' ELSE 'neutral' END AS polarity,
    CASE WHEN l_quantity > 33 THEN 'high' WHEN l_quantity > 16 THEN 'medium' ELSE 'low' END AS strength, 'order ' || l_orderkey AS summary
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey)"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL if it has one."""

    def add(f: Callable) -> Callable:
        @wraps(f)
        def scoped(spark, sf_dir):
            with scope():
                return f(spark, sf_dir)

        QUERIES[f.__name__] = scoped
        if sql:
            SQL[f.__name__] = sql
        return f

    return add
