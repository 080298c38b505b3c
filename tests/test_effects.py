"""Balance, effects, WLS, bins and AUC against numpy / pandas on small frames."""

import numpy as np
import pandas as pd

from equipoise.operators import balance as B
from equipoise.operators import effects as E
from equipoise.operators import propensity as P
from equipoise.operators.bins import equal_width_bins, equal_width_edges, histogram, width_bins


def _frame(seed=0, n=400):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 2, n)
    x = rng.normal(size=n) + t
    y = 0.3 * t + 0.1 * x + rng.normal(size=n)
    w = rng.uniform(0.5, 3, n)
    dose = rng.integers(0, 10, n) * 30.0
    return pd.DataFrame({"id": np.arange(n), "t": t, "x": x, "y": y, "w": w, "dose": dose})


def test_balance_treated_sd_and_zero_sd(spark):  # Q11
    pdf = _frame()
    pdf["const"] = 1.0
    bal = {r.variable: r for r in B.balance(spark.createDataFrame(pdf), ["x", "const"], "t").collect()}
    tr, co = pdf[pdf.t == 1], pdf[pdf.t == 0]
    smd = (tr.x.mean() - co.x.mean()) / tr.x.std()
    assert abs(bal["x"].smd - smd) < 1e-12 and bal["const"].smd == 0.0


def test_treatment_effect_matches_pandas(spark):
    pdf = _frame()
    res = {r.metric: r.value for r in E.treatment_effect(spark.createDataFrame(pdf), "y", "t").collect()}
    tr, co = pdf[pdf.t == 1].y, pdf[pdf.t == 0].y
    se = np.sqrt((tr.std() / np.sqrt(len(tr))) ** 2 + (co.std() / np.sqrt(len(co))) ** 2)
    assert abs(res["Treatment Effect"] - (tr.mean() - co.mean())) < 1e-12
    assert abs(res["SE"] - se) < 1e-12 and abs(res["CI Upper"] - (tr.mean() - co.mean() + 1.96 * se)) < 1e-12


def test_wls_matches_numpy(spark):
    pdf = _frame(1)
    rows = {r.term: r for r in E.wls(spark.createDataFrame(pdf), "y", "x", "w").collect()}
    X = np.column_stack([np.ones(len(pdf)), pdf.x])
    sw = np.sqrt(pdf.w.values)
    beta, *_ = np.linalg.lstsq(X * sw[:, None], pdf.y.values * sw, rcond=None)
    resid = (pdf.y.values - X @ beta) * sw
    s2 = resid @ resid / (len(pdf) - 2)
    cov = s2 * np.linalg.inv((X * sw[:, None]).T @ (X * sw[:, None]))
    assert abs(rows["Intercept"].coef - beta[0]) < 1e-9 and abs(rows["x"].coef - beta[1]) < 1e-9
    assert abs(rows["x"].se - np.sqrt(cov[1, 1])) < 1e-9 and abs(rows["Intercept"].se - np.sqrt(cov[0, 0])) < 1e-9
    ybar = np.average(pdf.y, weights=pdf.w)
    r2 = 1 - resid @ resid / np.sum(pdf.w * (pdf.y - ybar) ** 2)
    assert abs(rows["x"].r_squared - r2) < 1e-9


def test_subgroup_effect_binary_slope_and_one_arm(spark):  # Q17
    pdf = _frame(2, 300)
    pdf["g"] = np.where(pdf.id < 150, "a", "b")
    pdf.loc[pdf.g == "b", "t"] = 1  # group b has one arm only
    res = {r.category: r for r in
           E.subgroup_effects(spark.createDataFrame(pdf), "y", "t", "w", {"G": "g"}, 50).collect()}
    a = pdf[pdf.g == "a"]
    exp = np.average(a[a.t == 1].y, weights=a[a.t == 1].w) - np.average(a[a.t == 0].y, weights=a[a.t == 0].w)
    assert abs(res["a"].effect - exp) < 1e-12 and res["b"].effect is None and res["a"].sample_size == 150


def test_width_bins_last_edge_excluded(spark):  # Q9
    df = spark.createDataFrame([(0.0,), (59.0,), (60.0,), (119.0,), (120.0,)], "m double")
    got = [(r.m, r.dose_bin) for r in width_bins(df, "m", 60.0).collect()]
    assert got == [(0.0, "0.0-59.0"), (59.0, "0.0-59.0"), (60.0, "60.0-119.0"), (119.0, "60.0-119.0"), (120.0, None)]
    zero = spark.createDataFrame([(0.0,), (0.0,)], "m double")
    assert {r.dose_bin for r in width_bins(zero, "m", 60.0).collect()} == {"0-59"}


def test_weighted_bin_stats_match_reference_formula(spark):
    pdf = _frame(3)
    binned = width_bins(spark.createDataFrame(pdf), "dose", 60.0)
    res = {r.dose_bin: r for r in E.weighted_bin_stats(binned, "dose_bin", "y", "w").collect()}
    for lo in sorted(set((pdf.dose // 60) * 60)):  # max dose 270 is not a multiple of 60: every row is binned
        g = pdf[(pdf.dose >= lo) & (pdf.dose < lo + 60)]
        m = np.average(g.y, weights=g.w)
        se = np.sqrt(np.average((g.y - m) ** 2, weights=g.w) / len(g))
        r = res[f"{lo:.1f}-{lo + 59:.1f}"]
        assert abs(r["mean"] - m) < 1e-12 and abs(r.se - se) < 1e-12 and r["count"] == len(g)


def test_equal_width_edges_match_pandas_cut(spark):
    vals = np.array([0.1, 0.2, 0.55, 0.9, 0.9, 0.33])
    _, edges = pd.cut(vals, bins=3, retbins=True)
    assert np.allclose(equal_width_edges(vals.min(), vals.max(), 3), edges, rtol=0, atol=0)
    df = spark.createDataFrame(pd.DataFrame({"v": vals}))
    got = [r.band for r in equal_width_bins(df, "v", ["Poor", "Fair", "Good"], "band").collect()]
    exp = list(pd.cut(vals, bins=3, labels=["Poor", "Fair", "Good"]).astype(str))
    assert got == exp


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"g": rng.integers(0, 2, 500), "v": rng.uniform(size=500)})
    res = histogram(spark.createDataFrame(pdf), "v", 30, group="g").toPandas()
    for g in (0, 1):
        counts, edges = np.histogram(pdf[pdf.g == g].v, bins=30)
        part = res[res.g == g].sort_values("bin")
        assert list(part["count"]) == list(counts)
        assert np.allclose(part.bin_lo, edges[:-1], atol=1e-12)


def test_auc_tie_aware(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.uniform(size=300), 1)
    y = (rng.uniform(size=300) < s).astype(int)
    got = P.auc(spark.createDataFrame(pd.DataFrame({"s": s, "t": y})), "s", "t").first().auc
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert abs(got - exp) < 1e-12


def test_ipw_weights_drop_infinite(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (2, 0, 1.0), (3, 1, 0.25), (4, 0, None)], "id int, t int, ps double")
    got = {r.id: r.ipw_weight for r in E.ipw_weights(df, "ps", "t").collect()}
    assert got == {3: 4.0}


def test_wls_offset_constant_and_zero_weights(spark):
    r = np.random.default_rng(0).random(500)
    df = spark.createDataFrame(pd.DataFrame({"far": 1e8 + r, "y": 2 * r + 1, "w": 1.0, "same": 0.1, "none": 0.0}))
    far = {x.term: x for x in E.wls(df, "y", "far", "w").collect()}["far"]
    assert abs(far.coef - 2) < 1e-6 and far.r_squared > 0.999999
    for x, w in (("same", "w"), ("far", "none")):
        assert {r.coef for r in E.wls(df, "y", x, w).collect()} == {None}


def test_ipw_weights_drop_infinite(spark):
    df = spark.createDataFrame([(1, 1e-310), (1, 0.5), (0, 1.0), (0, None)], "t int, ps double")
    assert [r.ipw_weight for r in E.ipw_weights(df, "ps", "t").collect()] == [2.0]
