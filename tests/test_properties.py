"""Property tests: known-truth effect recovery, scaling range, matching == brute force."""

import numpy as np
import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equipoise.operators import effects as E
from equipoise.operators.matching import match_nearest, matched_cohort
from equipoise.operators.scaling import minmax_scale

TRUE_EFFECT = 0.2


def _simulated(n=4000, seed=7):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    ps = 1 / (1 + np.exp(-1.2 * x))
    t = (rng.uniform(size=n) < ps).astype(int)
    y = 0.5 + TRUE_EFFECT * t + 0.4 * x + rng.normal(scale=0.3, size=n)
    return pd.DataFrame({"id": np.arange(n), "t": t, "y": y, "x": x, "ps": ps})


def test_ipw_and_matching_recover_a_known_effect(spark):
    pdf = _simulated()
    df = spark.createDataFrame(pdf)
    naive = pdf[pdf.t == 1].y.mean() - pdf[pdf.t == 0].y.mean()
    assert naive > TRUE_EFFECT + 0.2  # confounded by x

    w = E.ipw_weights(df, "ps", "t")
    ipw = {r.term: r.coef for r in E.wls(w, "y", "t", "ipw_weight").collect()}["t"]
    assert abs(ipw - TRUE_EFFECT) < 0.06

    pairs = match_nearest(df, "ps", "t", "id", 0.01, 1)
    cohort = matched_cohort(df, pairs, "id")
    eff = {r.metric: r.value for r in E.treatment_effect(cohort, "y", "t").collect()}["Treatment Effect"]
    assert abs(eff - TRUE_EFFECT) < abs(naive - TRUE_EFFECT) / 2


def test_minmax_range(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.normal(size=200) * 50}))
    vals = [r.a_NORMALIZED for r in minmax_scale(df, ["a"]).collect()]
    assert min(vals) == 0.0 and max(vals) == 1.0


rows_strategy = st.lists(
    st.tuples(st.integers(0, 1), st.one_of(st.none(), st.integers(0, 40).map(lambda v: v / 40))),
    min_size=1, max_size=60)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=rows_strategy, k=st.integers(1, 3), caliper=st.sampled_from([0.0, 0.025, 0.1, 1.0]))
def test_matching_equals_brute_force_hypothesis(spark, rows, k, caliper):
    data = [(i, t, s) for i, (t, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, treated int, ps double")
    got = {(r.treated_id, r.control_id) for r in match_nearest(df, "ps", "treated", "id", caliper, k).collect()}
    want = set()
    controls = [(i, s) for i, t, s in data if t == 0 and s is not None]
    for i, t, s in data:
        if t == 1 and s is not None:
            cands = sorted((abs(cs - s), ci) for ci, cs in controls if abs(cs - s) <= caliper)
            want |= {(i, ci) for _, ci in cands[:k]}
    assert got == want
