"""Distributed running sums, row ids and exact quantiles against numpy."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from equipoise.operators import ranking as K
from equipoise.operators.ranking import (
    _bounds, _bucket, bracket_counts, cumulative_sum, describe, exact_quantiles, row_index)


def test_cumulative_sum_matches_pandas(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.permutation(500), "v": rng.integers(0, 10, 500)})
    df = spark.createDataFrame(pdf)
    got = cumulative_sum(df, "v", ["k"], partition_by=["g"], out="c", num_partitions=5).toPandas()
    exp = pdf.sort_values(["g", "k"]).assign(c=lambda x: x.groupby("g")["v"].cumsum() - x["v"])
    m = got.merge(exp, on=["g", "k", "v"], suffixes=("", "_e"))
    assert len(m) == 500 and (m["c"] == m["c_e"]).all()


def test_row_index_is_dense_and_ordered(spark):
    df = spark.range(1000).selectExpr("id * 7 % 1000 AS key")
    got = row_index(df, ["key"], out="rid", num_partitions=6).toPandas().sort_values("key")
    assert list(got["rid"]) == list(range(1000))


def test_exact_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = np.round(rng.normal(size=301), 2)  # ties included
    df = spark.createDataFrame(pd.DataFrame({"x": vals}))
    q = {r.prob: r.value for r in exact_quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75, 1.0]).collect()}
    for p, v in q.items():
        assert abs(v - np.percentile(vals, p * 100)) < 1e-12


def test_describe_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 4.0, None, 8.0], "b": [3.0, 3.0, 3.0, 3.0, 3.0]})
    d = {r.variable: r for r in describe(spark.createDataFrame(pdf), ["a", "b"]).collect()}
    ref = pdf.describe()
    for c in ("a", "b"):
        assert d[c]["count"] == ref[c]["count"]
        for ours, theirs in (("mean", "mean"), ("std", "std"), ("min", "min"), ("q25", "25%"), ("q50", "50%"),
                             ("q75", "75%"), ("max", "max")):
            assert abs(d[c][ours] - ref[c][theirs]) < 1e-12


def test_ranking_shuffles_the_data_once_and_splits_a_common_value(spark):
    df = spark.range(0, 120_000, numPartitions=4).selectExpr(
        "id", "IF(id % 10 < 9, 0.0, id * 1.0) AS v", "repeat('x', 20) AS payload")
    ranked = cumulative_sum(df, F.lit(1), ["v", "id"], out="c", num_partitions=8)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    heavy = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "payload" in line]
    assert plan.count("rangepartitioning") == 0 and len(heavy) <= 1
    sizes = [r["count"] for r in ranked.groupBy((F.col("c") / 15_000).cast("int").alias("b")).count().collect()]
    assert sum(sizes) == 120_000
    bounds = _bounds(df, [F.col("v"), F.col("id")], 8)
    per = [r["count"] for r in df.groupBy(_bucket(df, [F.col("v"), F.col("id")], bounds).alias("b")).count().collect()]
    assert len(per) == 8 and max(per) < 2 * 120_000 / 8


def test_describe_counts_equal_values_first(spark):
    df = spark.range(0, 50_000).selectExpr("IF(id % 10 < 9, 0.0, id * 1.0) AS v")
    row = describe(df, ["v"]).first()
    assert (row["count"], row["q25"], row["q50"], row["q75"], row["max"]) == (50_000, 0.0, 0.0, 0.0, 49_999.0)


def test_quantiles_shuffle_brackets_not_values(spark):
    df = spark.range(0, 200_000, numPartitions=6).selectExpr(
        "CAST(id * 7919 % 200000 AS DOUBLE) AS distinct_values", "2.5 AS equal_values", "CAST(NULL AS DOUBLE) AS nothing")
    columns, probs = ["distinct_values", "equal_values", "nothing"], [0.0, 0.25, 0.5, 0.999, 1.0]
    stats = K._pivots(df, columns, probs)
    assert sorted(stats) == ["distinct_values", "equal_values"]  # a column without values has no quantiles
    counts = bracket_counts(df, {c: K._disjoint(s["brackets"]) for c, s in stats.items()})
    assert counts.count() < 2_000  # of 200,001 distinct values
    got = {(r.variable, r.prob): r.value for r in exact_quantiles(df, columns, probs).collect()}
    for p in probs:
        assert got["equal_values", p] == 2.5 and abs(got["distinct_values", p] - p * 199_999) < 1e-6
    assert len(got) == 10
    d = {r.variable: r for r in describe(df, columns).collect()}
    assert len(d) == 2 and d["distinct_values"].q50 == 99_999.5 and d["equal_values"]["std"] == 0.0


def test_a_bracket_that_misses_is_replaced(spark, monkeypatch):
    vals = np.arange(100.0)
    df = spark.createDataFrame(pd.DataFrame({"x": vals, "y": vals}))
    pivots = K._pivots

    def wrong(df, columns, probs):
        out = pivots(df, columns, probs)
        out["x"]["brackets"] = [(90.0, 95.0)] * len(probs)
        return out

    monkeypatch.setattr(K, "_pivots", wrong)
    got = {(r.variable, r.prob): r.value for r in exact_quantiles(df, ["x", "y"], [0.25, 0.5]).collect()}
    assert got == {(c, p): np.percentile(vals, 100 * p) for c in "xy" for p in (0.25, 0.5)}


def test_no_cache_is_left_behind(spark):
    from equipoise.operators.matching import match_nearest, matched_cohort
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    df = spark.range(0, 500).selectExpr("id", "CAST(id % 3 = 0 AS INT) AS t", "id / 500 AS ps")
    assert matched_cohort(df, match_nearest(df, "ps", "t", "id"), "id").count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
