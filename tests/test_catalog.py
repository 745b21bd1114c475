"""Registered queries against their SQL forms on the smallest data."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, canonical

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["turns_profile", "recent_exchanges", "candidate_dedup", "parsed_candidates", "greedy_merge", "entity_components",
          "asserted_edges", "retry_set", "phase_timeline", "trace_edges", "rendered_summary", "op_replay", "branch_timeline",
          "graph_roundtrip", "guard_clean", "reframe_best"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def test_every_query_has_a_plan_and_nothing_else_has_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(p) for p in entry.queries().values())


@pytest.mark.parametrize("name", SAMPLE)
def test_equal_to_sql(spark, con, name):
    df = entry.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in df.collect()]
    rel = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    assert canonical(df.columns, rows) == canonical(cols, rel.fetchall())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["session_id", "node_id", "label", "text", "turn_index", "speaker", "quote"] and df.count() > 0
