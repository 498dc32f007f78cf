"""Every query of the engine against its SQL."""

import re

import duckdb
import pytest

from brindle import file_queries, queries

DIR = "/root/testdata/sf0.001"
QUERIES, ORACLE = queries.QUERIES | file_queries.QUERIES, queries.ORACLE | file_queries.ORACLE


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    want = con.sql(ORACLE[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(repr(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def plan_of(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def pushed(plan):
    """What stands in the brackets of PushedFilters."""
    return re.findall(r"PushedFilters: \[(.*?)\]", plan)


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("match_exact_and", ["EqualTo(event_type,error)", "EqualTo(user_id,7)"]),
        ("match_exact_priority", ["EqualTo(event_type,error)"]),
        ("match_exact_unit_field", ["EqualTo(event_type,error)"]),
        ("match_unit", ["EqualTo(event_type,error)"]),
        ("global_and_or_groups", ["In(user_id, [7,8])|Or(EqualTo(user_id,7),EqualTo(user_id,8))"]),
        ("since", ["GreaterThanOrEqual(ts,"]),
        ("until", ["LessThanOrEqual(ts,"]),
        ("window_point", ["GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"]),
        ("after_cursor", ["GreaterThanOrEqual(ts,"]),
        ("seek_cursor", ["GreaterThanOrEqual(ts,"]),
        ("cursor_text_resume", ["GreaterThanOrEqual(ts,"]),
        ("tail_unit_window", ["EqualTo(event_type,error)", "GreaterThanOrEqual(ts,", "LessThanOrEqual(ts,"]),
    ],
)
def test_terms_and_bounds_reach_the_scan(spark, name, wanted):
    (found,) = pushed(plan_of(spark, name))
    for w in wanted:
        assert any(x in found for x in w.split("|")), found


def test_top_k(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "tail_n")
