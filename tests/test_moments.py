"""Mergeable moments, Student's tail, stacked logistic fits, reuse weights and the spec test against numpy."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from equipoise.functions.student import t_two_sided
from equipoise.operators import balance as B
from equipoise.operators import effects as E
from equipoise.operators import moments as M
from equipoise.operators.logistic import fit_logistics
from equipoise.operators.matching import match_nearest, match_scores, reuse_weights
from equipoise.plans.specs import spec_test_with_scores, with_config_label, with_survey_interactions


def _frame(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"id": np.arange(n), "t": rng.integers(0, 2, n), "x": 1e8 + rng.normal(size=n), "y": rng.normal(size=n),
                        "w": rng.uniform(0.1, 3, n), "g": rng.choice(["a", "b", None], n), "h": rng.integers(0, 3, n)})
    return pdf


def test_moments_of_keys_with_null_and_many_tasks(spark, monkeypatch):
    pdf = _frame()
    pdf.loc[5, "y"] = np.nan
    monkeypatch.setattr(M, "HELD_KEYS", 2)
    df = spark.createDataFrame(pdf).withColumn("y", F.nanvl("y", F.lit(None))).repartition(7)
    got = {(r.g, r.h): r for r in M.moments(df, "x", "y", "w", ["g", "h"]).collect()}
    assert len(got) == 9
    for (g, h), part in pdf.dropna(subset=["y"]).groupby([pdf.g.fillna("-"), "h"]):
        r = got[None if g == "-" else g, h]
        mx, my = np.average(part.x, weights=part.w), np.average(part.y, weights=part.w)
        assert r.n == len(part) and abs(r.w - part.w.sum()) < 1e-9 and abs(r.mx - mx) < 1e-6 and abs(r.my - my) < 1e-12
        for name, want in (("sxx", (part.w * (part.x - mx) ** 2).sum()), ("syy", (part.w * (part.y - my) ** 2).sum()),
                           ("sxy", (part.w * (part.x - mx) * (part.y - my)).sum())):
            assert abs(r[name] - want) < 1e-5 * max(1, abs(want))


def test_moments_read_the_rows_once(spark, tmp_path):
    spark.createDataFrame(_frame(50)).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    for out in (E.wls(df, "y", "x", "w"), E.weighted_bin_stats(df, "h", "y", "w"), E.subgroup_effects(df, "y", "t", "w", {"G": "g", "H": "h"}, 5)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == 1
        assert plan.index("Generate") < plan.index("MapInArrow") if "Generate" in plan else True  # cells are multiplied, rows aren't


def test_no_rows(spark):
    df = spark.createDataFrame([], "t int, x double, y double, w double, g string")
    assert [(r.term, r.coef, r.n) for r in E.wls(df, "y", "x", "w").collect()] == [("Intercept", None, 0), ("x", None, 0)]
    assert E.subgroup_effects(df, "y", "t", "w", {"G": "g"}).count() == 0 and E.weighted_bin_stats(df, "g", "y", "w").count() == 0


def _tail(t, v):
    angle, n = math.atan(abs(t) / math.sqrt(v)), 100_001
    f = np.cos(np.linspace(0, angle, n)) ** (v - 1)
    integral = angle / (n - 1) / 3 * (f[0] + f[-1] + 4 * f[1:-1:2].sum() + 2 * f[2:-1:2].sum())
    return 1 - 2 * math.exp(math.lgamma((v + 1) / 2) - math.lgamma(v / 2)) / math.sqrt(math.pi) * integral


def test_students_tail(spark):
    rows = [(float(t), float(v)) for t in (0.0, 1e-8, -0.1, 0.5, 1.0, -1.7, 2.0, 3.0, 5.0, 8.0) for v in (1, 2, 3, 5, 10, 50, 1447, 1e5)]
    for r in spark.createDataFrame(rows, "t double, v double").select("t", "v", t_two_sided(F.col("t"), F.col("v")).alias("p")).collect():
        assert abs(r.p - _tail(r.t, r.v)) < 1e-10
    odd = spark.createDataFrame([(None, 3.0), (1.0, 0.0), (1.0, None), (math.inf, 4.0)], "t double, v double")
    assert [r.p for r in odd.select(t_two_sided(F.col("t"), F.col("v")).alias("p")).collect()] == [None, None, None, 0.0]


def test_subgroup_p_values(spark):
    pdf = _frame(600)
    got = {(r.subgroup, r.category): r for r in E.subgroup_effects(spark.createDataFrame(pdf), "y", "t", "w", {"G": "g", "H": "h"}, 50).collect()}
    assert set(got) == {("G", "a"), ("G", "b"), ("H", "0"), ("H", "1"), ("H", "2")}
    part = pdf[pdf.g == "a"]
    X, w = np.column_stack([np.ones(len(part)), part.t]), part.w.values
    gram = np.linalg.inv(X.T @ (X * w[:, None]))
    beta = gram @ X.T @ (w * part.y.values)
    resid = part.y.values - X @ beta
    se = math.sqrt((w * resid * resid).sum() / (len(part) - 2) * gram[1, 1])
    r = got["G", "a"]
    assert abs(r.effect - beta[1]) < 1e-10 and abs(r.se - se) < 1e-10 and abs(r.p_value - _tail(beta[1] / se, len(part) - 2)) < 1e-9


def _newton(X, y, C=1.0):
    X = np.column_stack([np.ones(len(X)), X])
    b, ridge = np.zeros(X.shape[1]), np.append(0.0, np.full(X.shape[1] - 1, 1 / C))
    for _ in range(60):
        p = 1 / (1 + np.exp(-X @ b))
        b = b - np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X + np.diag(ridge), X.T @ (p - y) + ridge * b)
    return b


def test_fits_of_several_sets_share_their_steps(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(500, 3)), columns=["a", "b", "c"])
    pdf["t"] = (rng.uniform(size=500) < 1 / (1 + np.exp(-2 * pdf.a + pdf.b))).astype(int)
    pdf["k"] = 1.0  # constant
    pdf["spec"] = np.where(np.arange(500) < 300, "two", "three")
    df = spark.createDataFrame(pdf)
    fits = fit_logistics(df, {"one": ["a"], "all": ["a", "b", "c"], "constant": ["k", "b"]}, "t")
    for name, columns in (("one", ["a"]), ("all", ["a", "b", "c"]), ("constant", ["k", "b"])):
        want = _newton(pdf[columns].values, pdf.t.values)
        got = fits[name]
        assert abs(got.intercept - want[0]) < 1e-8 and np.allclose(got.coefficients, want[1:], atol=1e-8)
    own = fit_logistics(df, {"two": ["a", "b"], "three": ["a", "b", "c"]}, "t", of_set="spec")
    for name, columns in (("two", ["a", "b"]), ("three", ["a", "b", "c"])):
        part = pdf[pdf.spec == name]
        assert np.allclose(own[name].coefficients, _newton(part[columns].values, part.t.values)[1:], atol=1e-8)


def test_separated_arms_still_converge(spark):
    pdf = pd.DataFrame({"a": np.linspace(-50, 50, 200), "t": (np.linspace(-50, 50, 200) > 0).astype(int)})
    fit = fit_logistics(spark.createDataFrame(pdf), {"m": ["a"]}, "t")["m"]
    assert np.isfinite(fit.coefficients).all() and fit.coefficients[0] > 0


def _cohort(n=300, seed=4):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": np.arange(n), "t": (rng.uniform(size=n) < 0.6).astype(int), "y": rng.integers(0, 2, n),
                         "x": rng.normal(size=n), "z": rng.normal(size=n), "ps": np.round(rng.uniform(size=n), 2),
                         "qs": np.where(rng.uniform(size=n) < 0.1, None, rng.uniform(size=n)).astype(float)})


def test_several_scores_match_as_each_alone(spark):
    df = spark.createDataFrame(_cohort()).withColumn("qs", F.nanvl("qs", F.lit(None)))
    both = match_scores(df, {"p": "ps", "q": "qs"}, "t", "id", [(0.02, 1), (0.1, 2)]).collect()
    for spec, column in (("p", "ps"), ("q", "qs")):
        for i, (caliper, ratio) in enumerate([(0.02, 1), (0.1, 2)]):
            alone = match_nearest(df, column, "t", "id", caliper, ratio).collect()
            assert sorted((r.treated_id, r.control_id) for r in both if r.spec == spec and r.setting == i) == \
                sorted((r.treated_id, r.control_id) for r in alone)


def test_reuse_weights_and_balance(spark):
    pdf = _cohort()
    df = spark.createDataFrame(pdf)
    pairs = match_nearest(df, "ps", "t", "id", 0.05, 2)
    cohort = reuse_weights(df, pairs, "id").toPandas()
    found = pairs.toPandas()
    k = found.groupby("treated_id").size()
    assert len(cohort) == found.treated_id.nunique() + found.control_id.nunique()
    want = found.assign(s=1 / found.treated_id.map(k)).groupby("control_id").s.sum()
    own = cohort[cohort.t == 0].set_index("id").match_weight
    assert np.allclose(own.sort_index(), want.sort_index()) and abs(own.sum() - k.size) < 1e-9
    b = {r.variable: r for r in B.weighted_balance(spark.createDataFrame(cohort), ["x", "z"], "t", "match_weight").collect()}
    tr, co = cohort[cohort.t == 1], cohort[cohort.t == 0]
    w = co.match_weight
    mean = np.average(co.x, weights=w)
    assert abs(b["x"].control_mean - mean) < 1e-12 and abs(b["x"].smd - (tr.x.mean() - mean) / tr.x.std()) < 1e-12
    assert abs(b["x"].control_ess - w.sum() ** 2 / (w * w).sum()) < 1e-9 and b["x"].treated_ess == len(tr)
    plain = {r.variable: r.smd for r in B.balance(spark.createDataFrame(cohort), ["x"], "t").collect()}
    ones = B.weighted_balance(spark.createDataFrame(cohort).withColumn("one", F.lit(1.0)), ["x"], "t", "one").first()
    assert abs(ones.smd - plain["x"]) < 1e-12
    effect = {r.metric: r.value for r in E.weighted_treatment_effect(spark.createDataFrame(cohort), "y", "t", "match_weight").collect()}
    assert abs(effect["Treatment Effect"] - (tr.y.mean() - np.average(co.y, weights=w))) < 1e-12


def test_spec_test_ranks_once_and_returns_each_covariate(spark, monkeypatch):
    import equipoise.operators.matching as matching
    calls = []
    real = matching.cumulative_sum
    monkeypatch.setattr(matching, "cumulative_sum", lambda *a, **k: (calls.append(1), real(*a, **k))[1])
    df = spark.createDataFrame(_cohort()).withColumn("qs", F.nanvl("qs", F.lit(None)))
    test = spec_test_with_scores(df, {"p": "ps", "q": "qs"}, {"p": ["x", "z"], "q": ["x"]}, "id", "t", "y", [(0.02, 1), (0.1, 2)])
    assert len(calls) == 1
    balance = test.balance.toPandas()
    assert len(balance) == 6 and set(balance[balance.spec_name == "q"].variable) == {"x"}
    results = test.results.toPandas().set_index(["spec_name", "ratio"])
    assert len(results) == 4
    for key, part in balance.groupby(["spec_name", "ratio"]):
        assert abs(results.loc[key, "avg_abs_std_diff"] - part.smd.abs().mean()) < 1e-12
    assert {r.label for r in with_config_label(test.results).collect()} >= {"p + caliper=0.02, ratio=1"}


def test_survey_interactions(spark):
    df = spark.createDataFrame([("a", "x", 2.0, "lo"), ("b", "y", 1.0, None), (None, "x", None, "hi")],
                               "SEXVAR string, EMPLOY1 string, DISABILITY_INDEX_NORMALIZED double, INCOME3 string")
    rows = with_survey_interactions(df).collect()
    got = sorted(((r.SEXVAR_AGE_INTERACTION, r.DISABILITY_EMPLOYMENT_INTERACTION) for r in rows), key=repr)
    assert got == sorted([(0, 0.0), (50, 1.0), (None, None)], key=repr)
    assert "INCOME_EDUCA_INTERACTION" not in rows[0].asDict()  # the table has no EDUCA


@pytest.mark.parametrize("hot", [True, False])
def test_salted_rows_are_dealt_by_their_columns(spark, monkeypatch, hot):
    import equipoise.operators.joins as joins
    monkeypatch.setattr(joins, "fits_broadcast", lambda *a, **k: False)
    big = spark.range(1000).selectExpr("id", "id % 2 AS k")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    out = joins.hot_key_join(big, small, ["k"], hot=[(0,)] if hot else [])
    assert "monotonically" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 1000
