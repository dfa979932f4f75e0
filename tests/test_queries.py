"""Every query with SQL against DuckDB on the same tables."""

import duckdb
import pandas as pd
import pytest

from inkloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {"html_text", "chapter_slices", "hybrid_search", "deep_search", "plot_entity_merge", "stitched_plots", "research_rounds"}


@pytest.fixture(scope="module")
def con(small):
    found = duckdb.connect()
    for t in TABLES:
        found.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return found


def plain(frame):
    columns = sorted(frame.columns)
    value = lambda v: None if v is None or v is pd.NA or v != v else v.item() if hasattr(v, "item") else v
    return columns, sorted(repr([float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x for x in map(value, row)]) for row in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, small, con, name):
    got, expected = plain(registry.queries()[name](spark, small).toPandas()), plain(con.sql(registry.oracle_sql()[name]).df())
    assert got == expected


def test_rows_only(spark, small):
    assert set(registry.queries()) - set(registry.oracle_sql()) == WITHOUT_SQL
    for name in WITHOUT_SQL:
        assert registry.queries()[name](spark, small).count() > 0


def test_entry(spark, small):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["book_id", "chapter_index", "sample_id", "tail_chars", "prompt_sha256"]
    assert set(registry.queries()) <= set(entry.queries()) and set(registry.oracle_sql()) <= set(entry.oracle_sql())
