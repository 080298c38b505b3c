"""Model operators: logistic equals the C=1 L2 objective, forest is seeded and well-formed, analyses run."""

import numpy as np
import pandas as pd
from pyspark.sql import Observation
from pyspark.sql import functions as F

from equipoise.operators import propensity as P
from equipoise.plans.matching import MatchingAnalysis
from equipoise.plans.specs import best_spec, spec_grid
from equipoise.plans.weighting import WeightingAnalysis
from equipoise.session import reliable_checkpoint


def _confounded(n=600, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    p = 1 / (1 + np.exp(-(0.8 * x1 - 0.5 * x2)))
    t = (rng.uniform(size=n) < p).astype(int)
    y = (rng.uniform(size=n) < 0.3 + 0.2 * t + 0.1 * (x1 > 0)).astype(int)
    return pd.DataFrame({"id": np.arange(n), "t": t, "y": y, "x1": x1, "x2": x2,
                         "seg": np.where(x2 > 0, "hi", "lo")})


def _newton(X, y, C=1.0):
    Xi = np.column_stack([np.ones(len(X)), X])
    w = np.zeros(Xi.shape[1])
    reg = np.eye(len(w)) / C
    reg[0, 0] = 0
    for _ in range(50):
        p = 1 / (1 + np.exp(-Xi @ w))
        g = Xi.T @ (p - y) + reg @ w
        H = (Xi * (p * (1 - p))[:, None]).T @ Xi + reg
        w -= np.linalg.solve(H, g)
    return w


def test_logistic_equals_c1_objective(spark):
    pdf = _confounded()
    df = spark.createDataFrame(pdf)
    model = P.fit_logistic(df, ["x1", "x2"], "t")
    w = _newton(pdf[["x1", "x2"]].values, pdf.t.values)
    assert abs(model.intercept - w[0]) < 1e-5 and np.allclose(model.coefficients, w[1:], atol=1e-8)


def test_forest_scores_seeded_and_informative(spark):
    pdf = _confounded()
    df = spark.createDataFrame(pdf)
    m1 = P.fit_random_forest(df, ["x1", "x2"], "t", num_trees=20)
    m2 = P.fit_random_forest(df, ["x1", "x2"], "t", num_trees=20)
    s1 = P.score(m1, df, ["x1", "x2"]).orderBy("id").toPandas()
    s2 = P.score(m2, df, ["x1", "x2"]).orderBy("id").toPandas()
    assert np.array_equal(s1.propensity_score, s2.propensity_score)
    assert s1.propensity_score.between(0, 1).all()
    assert P.auc_value(P.score(m1, df, ["x1", "x2"]), "propensity_score", "t") > 0.6
    imp = P.feature_importance(m1, ["x1", "x2"], spark).collect()
    assert imp[0].confounder == "x1" and abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_forest_scores_in_a_session_that_observed_something(spark):
    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get == {"n": 3}
    df = reliable_checkpoint(spark.createDataFrame(_confounded(200)))
    model = P.fit_random_forest(df, ["x1", "x2"], "t", num_trees=5)
    scored = reliable_checkpoint(P.score(model, df, ["x1", "x2"]))
    assert scored.where("propensity_score BETWEEN 0 AND 1").count() == 200


def test_matching_analysis_end_to_end(spark):
    df = spark.createDataFrame(_confounded())
    m = MatchingAnalysis(df, "id", "t", "y", ["x1", "x2", "seg", "missing"], ["seg"]).run(model="logistic")
    eff = {r.metric: r.value for r in m.effect().collect()}
    before = {r.variable: abs(r.smd) for r in m.balance_before().collect()}
    after = {r.variable: abs(r.smd) for r in m.balance_after().collect()}
    assert set(before) == {"x1", "x2", "seg"}
    assert after["x1"] < before["x1"]  # matching improves balance on the strongest confounder
    assert eff["CI Lower"] < eff["Treatment Effect"] < eff["CI Upper"]
    sizes = {(r.stage, r.treated): r.n for r in m.sample_sizes().collect()}
    assert sizes[("before", 1)] >= sizes[("after", 1)]


def test_spec_grid_rows_and_best(spark):
    df = spark.createDataFrame(_confounded(300))
    res = spec_grid(df, {"one": ["x1"], "two": ["x1", "x2"]}, "id", "t", "y", grid=[(0.05, 1), (0.1, 2)],
                    rf_params={"num_trees": 10, "max_depth": 3, "seed": 42})
    rows = res.collect()
    assert len(rows) == 4 and all(r.n_matches > 0 for r in rows)
    best = best_spec(res).first()
    assert best.avg_abs_std_diff == min(r.avg_abs_std_diff for r in rows)


def _counted(spark, df):
    """``df`` and how many of its rows have been computed so far."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return df.mapInPandas(count, df.schema), seen


def test_weighting_computes_its_table_once(spark):
    df, seen = _counted(spark, spark.createDataFrame(_confounded(200)).withColumn("dose", F.col("x1") * 10 + 50))
    w = WeightingAnalysis(df, "id", "t", "y", "dose", ["x1", "x2", "seg"], ["seg"]).prepare({"num_trees": 3, "max_depth": 2, "seed": 1})
    assert sum(r["count"] for r in w.dose_response().collect()) == 200
    assert seen.value == 200


def test_spec_grid_computes_its_table_once(spark):
    df, seen = _counted(spark, spark.createDataFrame(_confounded(200)))
    res = spec_grid(df, {"one": ["x1"], "two": ["x1", "seg"]}, "id", "t", "y", ["seg"], grid=[(0.1, 1)],
                    rf_params={"num_trees": 3, "max_depth": 2, "seed": 42})
    assert res.count() == 2
    assert seen.value == 200
