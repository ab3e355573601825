"""Every registered query against its SQL oracle on the small tables (the
driver repeats this at sf0.01); queries without an oracle must run."""

from __future__ import annotations

import pytest

from kiln.plans.registry import ORACLES, QUERIES, load_all
from tests.oracle import assert_same, duck

load_all()
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(small_dir):
    return duck(small_dir)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, small_dir, con, key):
    df = QUERIES[key](spark, small_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # scale guard: no query may pair rows all-against-all
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, key
    if key in ORACLES:
        assert_same(df, con, ORACLES[key])
    else:
        assert df.count() >= 0


def test_every_inventory_section_is_registered():
    prefixes = {k.split("_")[0] for k in QUERIES}
    for p in ("src", "snk", "prj", "feed", "mkt", "art", "join", "agg", "win", "cal", "top", "set", "scl", "str",
              "sql", "report", "dq", "import"):
        assert p in prefixes, p


def test_entry_contract(spark):
    import __spark_entry__ as E

    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


def test_filters_and_columns_reach_the_scan(spark, small_dir):
    plan = QUERIES["join_left_lookup"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderstatus), IsNotNull(o_orderdate), EqualTo(o_orderstatus,F)" in plan
    scan = [ln for ln in plan.splitlines() if "FileScan parquet" in ln and "orders" in ln][0]
    assert "o_totalprice" not in scan  # unused columns are pruned


def test_rollups_aggregate_before_the_shuffle(spark, small_dir):
    plan = QUERIES["agg_run_rollup"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "partial_count" in plan


def test_flagship_reads_only_needed_columns(spark, small_dir):
    plan = QUERIES["join_parent_child"](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan parquet" in ln]
    line_scan = [ln for ln in scans if "lineitem" in ln][0]
    assert "l_orderkey" in line_scan and "l_returnflag" in line_scan
    for unused in ("l_extendedprice", "l_partkey", "l_comment", "l_tax"):
        assert unused not in line_scan
