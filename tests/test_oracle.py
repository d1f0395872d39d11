"""Registered queries against their SQL at the smallest scale; check_oracle.py runs all of them."""

import duckdb
import pytest

import __spark_entry__ as entry
from check_oracle import TABLES, rows

SAMPLE = [
    "t01_sections", "t02_pack_lines", "t04_supplied_fragments", "t07_blocks", "t10_split_documents", "t11_table_rows", "t22_section_links", "t26_rewrites",
    "s02_navigation", "s09_page_logs", "r01_lexical_topk", "r02_bm25_topk", "r04_multivector_topk", "m04_split_by_category", "m07_summarize", "m12_containment",
    "k02_assess", "k07_newest_snapshots", "v05_conditions_hold", "v10_check_steps", "a02_check_supports", "c06_compaction", "c10_draft_state", "x03_attempt_windows",
    "x02_newest_snapshots", "search_passages"]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, sf, con, name):
    df = entry.queries()[name](spark, sf)
    cur = con.execute(entry.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert "contains_passage" in df.columns and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["r01_lexical_topk_join", "t13_line_owner", "k02_assess", "k09_find_mentions", "m12_containment", "v05_conditions_hold", "v17_attached_rules"])
def test_no_cross_join(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scan_is_pruned(spark, sf):
    plan = entry.queries()["c10_draft_state"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "props" not in schema and "value" not in schema
