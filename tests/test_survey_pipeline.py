"""The survey configuration end to end on a generated extract: preprocess -> match (forest) -> weight."""

import numpy as np
import pandas as pd
import pytest

from equipoise.plans import survey_config as S
from equipoise.plans.matching import MatchingAnalysis, define_survey_variables
from equipoise.plans.preprocess import survey_preprocess
from equipoise.plans.weighting import survey_weighting


def _codes(rng, n, choices):
    return rng.choice(np.array(choices, dtype=float), size=n)


def survey_extract(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    yn = [1, 2]
    freq = list(range(101, 108)) + list(range(201, 231))
    cols = {
        "SEXVAR": yn, "MARITAL": list(range(1, 7)), "EDUCA": list(range(1, 7)), "RENTHOM1": [1, 2, 3],
        "VETERAN3": yn, "EMPLOY1": list(range(1, 9)), "CHILDREN": [1, 2, 3, 88], "INCOME3": list(range(1, 12)),
        "PREGNANT": yn, "WEIGHT2": list(range(100, 300)), "HEIGHT3": list(range(500, 612)),
        "SMOKE100": yn, "SMOKDAY2": [1, 2, 3], "ECIGNOW2": [1, 2, 3, 4], "ALCDAY4": freq + [888],
        "AVEDRNK3": list(range(1, 11)), "DRNK3GE5": list(range(1, 11)), "MAXDRNKS": list(range(1, 11)),
        "SOMALE": [1, 2, 3, 4], "SOFEMALE": [1, 2, 3, 4], "MARIJAN1": list(range(1, 31)) + [88],
        "LSATISFY": [1, 2, 3, 4], "EMTSUPRT": list(range(1, 6)), "SDLONELY": list(range(1, 6)), "SDHEMPLY": yn,
        "FOODSTMP": yn, "SDHFOOD1": list(range(1, 6)), "SDHBILLS": yn, "SDHUTILS": yn, "SDHTRNSP": yn,
        "SDHSTRE1": list(range(1, 6)), "PRIMINS1": list(range(1, 11)) + [88], "PERSDOC3": [1, 2, 3],
        "MEDCOST1": yn, "CHECKUP1": [1, 2, 3, 4, 8], "EXERANY2": yn, "EXRACT12": list(range(1, 12)),
        "EXRACT22": list(range(1, 12)), "EXERHMM1": list(range(10, 200)) + [800, 830],
        "EXERHMM2": list(range(10, 120)), "PHYSHLTH": list(range(1, 31)) + [88], "POORHLTH": list(range(1, 31)),
        "ADDEPEV3": yn, "_METSTAT": yn, "_URBSTAT": yn,
    }
    for c in S.DISABILITY_VARS:
        cols[c] = yn
    for c in S.ACE_MAPS:
        cols[c] = list(S.ACE_MAPS[c])[:-2]  # the answer codes, no refusal codes
    data = {c: _codes(rng, n, v) for c, v in cols.items()}
    # exercise depends on income and disability: a confounded treatment
    p_ex = 0.25 + 0.04 * data["INCOME3"] - 0.2 * (data["DEAF"] == 1)
    active = rng.uniform(size=n) < p_ex
    data["STRENGTH"] = np.where(active, _codes(rng, n, freq), 888.0)
    data["EXEROFT1"] = np.where(active & (rng.uniform(size=n) < 0.7), _codes(rng, n, freq), np.nan)
    data["EXEROFT2"] = np.where(active & (rng.uniform(size=n) < 0.3), _codes(rng, n, freq), np.nan)
    data["MENTHLTH"] = np.where(rng.uniform(size=n) < 0.3 + 0.2 * active, 88.0, _codes(rng, n, range(1, 31)))
    pdf = pd.DataFrame({c: data.get(c, np.full(n, np.nan)) for c in S.TARGET_VARIABLES})
    return pdf


@pytest.fixture(scope="module")
def processed(spark):
    raw = spark.createDataFrame(survey_extract())
    return define_survey_variables(survey_preprocess(raw)).persist()


def test_matching_analysis_on_survey(spark, processed):
    m = MatchingAnalysis(processed, "_SEQNO", "_EXERCISE_BINARY", "_MENTAL_HEALTH_BINARY", S.FULL_MODEL,
                         S.CATEGORICAL_VARS).run(caliper=S.MAIN_CALIPER, ratio=S.MAIN_RATIO)
    assert len(m.confounders) == 25
    auc = m.auc().first().auc
    assert 0.5 < auc <= 1.0
    before = {r.variable: abs(r.smd) for r in m.balance_before().collect()}
    after = {r.variable: abs(r.smd) for r in m.balance_after().collect()}
    assert set(before) == set(after) and all(np.isfinite(v) for v in after.values())
    pairs = m.pairs.toPandas()
    assert (pairs.distance <= S.MAIN_CALIPER).all() and pairs.treated_id.is_unique  # 1:1, inside the caliper
    eff = {r.metric: r.value for r in m.effect().collect()}
    assert eff["CI Lower"] < eff["Treatment Effect"] < eff["CI Upper"]
    imp = m.feature_importance().collect()
    assert len(imp) == 25 and imp[0].importance >= imp[-1].importance


def test_weighting_analysis_on_survey(spark, processed):
    wa = survey_weighting(processed).prepare()
    w = wa.analysis.select("ipw_weight").collect()
    assert len(w) > 100 and min(r.ipw_weight for r in w) >= 1.0
    bins = wa.dose_response().collect()
    assert bins and all(r["count"] > 0 and r.ci_lower <= r["mean"] <= r.ci_upper for r in bins)
    curve = wa.dose_curve().collect()
    assert len(curve) <= S.TOP_BINS and all(r["count"] > S.MIN_BIN_COUNT for r in curve)
    sub = wa.subgroup_effects().collect()
    names = {r.subgroup for r in sub}
    assert {"Gender", "Mental Health Baseline"} <= names
    assert all(r.sample_size >= S.MIN_SUBGROUP_SIZE for r in sub)
    genders = {r.category for r in sub if r.subgroup == "Gender"}
    assert genders <= {"Male", "Female"}  # decoded labels (C8), not codes
    trend = wa.trend().collect()
    assert len(trend) == 100
    assert {r.term for r in wa.effect().collect()} == {"Intercept", "_EXERCISE_BINARY"}
