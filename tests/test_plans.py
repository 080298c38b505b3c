"""Physical plans: no cartesian / nested-loop joins; filters and column pruning reach the parquet scan."""

import numpy as np
import pandas as pd

from equipoise.operators.bins import histogram
from equipoise.operators.matching import match_nearest
from equipoise.plans import fixtures as fx

SF = "/root/testdata/sf0.001"
BAD = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_histogram_without_group_has_no_nested_loop(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": np.linspace(0, 1, 50)}))
    p = plan(histogram(df, "v", 10))
    assert not any(b in p for b in BAD)


def test_matching_plan_has_no_all_pairs_join(spark):
    p = plan(match_nearest(fx.scored(spark, SF), "ps", "treated", "id", 0.05, 2))
    assert not any(b in p for b in BAD)


def test_pushdown_and_pruning_reach_the_scan(spark):
    u = fx.units(spark, SF).where("segment = 'BUILDING'").select("id", "acctbal")
    p = plan(u)
    assert "PushedFilters: [IsNotNull(c_mktsegment), EqualTo(c_mktsegment,BUILDING)" in p
    assert "o_orderdate" not in p and "o_totalprice" not in p  # unused order columns are never read
