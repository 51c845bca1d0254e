import pytest

from evlake.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["dup_pairs", "haversine_band", "region_members", "robots_decisions", "geocode_plan", "zip_place_lookup", "upsert_fold", "feed_top100", "profile_members", "health_states"])
def test_no_cross_joins(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_scans_read_what_they_need(spark):
    plan = catalog.QUERIES["feed_top100"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in plan and "WindowGroupLimit" in plan


def test_a_fold_is_one_shuffle(spark):
    plan = catalog.QUERIES["upsert_fold"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # one for the query's own numbering, one that the fold's window and aggregation share
    assert plan.count("Exchange hashpartitioning") <= 2


def test_every_oracle_has_a_query():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and catalog.FLAGSHIP in catalog.QUERIES


@pytest.mark.parametrize("name", ["dup_pairs", "haversine_band"])
def test_band_joins_convert_times_before_pairs(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line]
    assert joins and not any("unix_micros" in line or "as timestamp" in line for line in joins)
