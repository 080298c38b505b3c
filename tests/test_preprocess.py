"""The survey recode pipeline on a tiny hand-made survey extract, values worked out by hand."""

from equipoise.plans import survey_config as S
from equipoise.plans.matching import define_survey_variables
from equipoise.plans.preprocess import clean_section_names, survey_preprocess
from equipoise.plans.weighting import dose_measures
from equipoise.sources.codebook import survey_metadata


def _raw(spark):
    cols = S.TARGET_VARIABLES
    base = {c: None for c in cols}
    r1 = dict(base, SEXVAR=1, MARITAL=1, CHILDREN=88, WEIGHT2=7777, HEIGHT3=510, DEAF=1, BLIND=2, MENTHLTH=88,
              ACEDEPRS=1, ACEDRINK=2, ACEPUNCH=3, ALCDAY4=215, AVEDRNK3=3, SMOKE100=1, SMOKDAY2=2, ECIGNOW2=4,
              MARIJAN1=10, SOMALE=None, SOFEMALE=3, LSATISFY=2, SDHBILLS=1, SDHUTILS=7, PRIMINS1=88, PERSDOC3=1,
              STRENGTH=888, EXEROFT1=105, EXERHMM1=830, EXRACT12=2, _METSTAT=1, _URBSTAT=2)
    r2 = dict(base, SEXVAR=2, MARITAL=9, CHILDREN=3, WEIGHT2=150, DEAF=7, MENTHLTH=15, ACEDEPRS=7,
              ALCDAY4=None, SMOKE100=2, MARIJAN1=88, SOMALE=1, LSATISFY=4, SDHBILLS=2, SDHUTILS=2, SDHTRNSP=1,
              PRIMINS1=1, PERSDOC3=3, MEDCOST1=2, CHECKUP1=1, EXEROFT2=204, EXERHMM2=45, EXRACT12=3)
    r3 = dict(base, SEXVAR=1, MENTHLTH=3)
    schema = ", ".join(f"`{c}` double" for c in cols)
    rows = [tuple(None if r[c] is None else float(r[c]) for c in cols) for r in (r1, r2, r3)]
    return spark.createDataFrame(rows, schema)


def test_survey_pipeline_values(spark):
    out = survey_preprocess(_raw(spark))
    r1, r2, r3 = out.collect()
    assert set(S.DROP_COLUMNS).isdisjoint(out.columns)
    # ACE: r1 -> 1 + 0 + 1 = 2, r2 -> 0, r3 -> 0 ; sklearn-style scaling
    assert (r1.ACE_TOTAL, r2.ACE_TOTAL, r3.ACE_TOTAL) == (2.0, 0.0, 0.0)
    assert (r1.ACE_NORMALIZED, r2.ACE_NORMALIZED) == (1.0, 0.0)
    # alcohol: freq (15 / 4.3) / 30, drinks 3 / 15 -> mean of the two present parts
    assert abs(r1.ALCOHOL_SEVERITY - ((15 / 4.3) / 30 + 3 / 15) / 2) < 1e-15 and r2.ALCOHOL_SEVERITY is None
    # labels, children text, special weights
    assert (r1.SEXVAR, r1.MARITAL, r2.MARITAL) == ("Male", "Married", None)
    assert (r1.CHILDREN, r2.CHILDREN, r3.CHILDREN) == (None, "3", None)  # 88 is a blank label: missing (Q3)
    assert (r1.WEIGHT2, r2.WEIGHT2, r1.HEIGHT3) == (None, 150.0, 510.0)
    # disability: 1 of 6 flags
    assert (r1.DISABILITY_INDEX, r1.DISABILITY_INDEX_NORMALIZED, r2.DISABILITY_INDEX) == (1, 1 / 6, 0)
    assert (r1.METRO_AREA, r1.URBAN_RURAL_AREA) == ("Metropolitan", "Rural")
    # smoking: mean(1, 0.5, 0) = 0.5 ; r2 mean(0) = 0 ; unguarded scaling
    assert (r1.SMOKING_INDEX, r2.SMOKING_INDEX, r3.SMOKING_INDEX) == (0.5, 0.0, None)
    assert (r1.SMOKING_INDEX_NORMALIZED, r2.SMOKING_INDEX_NORMALIZED) == (1.0, 0.0)
    assert (r1.MARIJUANA_INDEX_NORMALIZED, r2.MARIJUANA_INDEX_NORMALIZED) == (10 / 30, 0.0)
    assert (r1.SEXUAL_ORIENTATION_SCORE, r2.SEXUAL_ORIENTATION_SCORE, r3.SEXUAL_ORIENTATION_SCORE) == (0.5, 1.0, 0.0)
    # financial: r1 bills 1 (w .4), utils 7 -> missing -> 1.0 ; r2 (0*.4 + 0*.3 + 1*.3) / 1.0
    assert r1.FINANCIAL_INSECURITY_INDEX == 1.0 and abs(r2.FINANCIAL_INSECURITY_INDEX - 0.3) < 1e-15
    assert r3.FINANCIAL_INSECURITY_INDEX is None and r1.FINANCIAL_INSECURITY_INDEX_NORMALIZED == 1.0
    # access: r1 mean(0.0, 1.0) = 0.5 ; r2 mean(0.8, 0.0, 1.0, 1.0) = 0.7
    assert r1.HEALTHCAREACCESS_INDEX_WEIGHTED == 0.5 and abs(r2.HEALTHCAREACCESS_INDEX_WEIGHTED - 0.7) < 1e-15
    # mental: 88 -> null (Q2), 15 -> 0.5
    assert (r1.MENTHLTH_MAPPED, r2.MENTHLTH_MAPPED) == (None, 0.5)
    # exercise
    assert (r1.STRENGTH_WEEKLY, r1.EXEROFT1_WEEKLY, r1.EXERHMM1_MIN) == (0.0, 5.0, 1800.0)
    assert abs(r2.EXEROFT2_WEEKLY - 4 / 4.345) < 1e-15 and r2.EXERHMM2_MIN == 45.0
    assert (r1.EXRACT12_ACTIVITY, r1.EXRACT12_AEROBIC, r2.EXRACT12_AEROBIC, r3.EXRACT12_AEROBIC) == (
        "running_jogging", True, False, False)


def test_survey_variables_and_dose(spark):
    df = define_survey_variables(survey_preprocess(_raw(spark)))
    rows = df.orderBy("_SEQNO").collect()
    assert [r._SEQNO for r in rows] == [0, 1, 2]
    assert [r._EXERCISE_BINARY for r in rows] == [1, 1, 0]
    assert [r._MENTAL_HEALTH_BINARY for r in rows] == [0, 1, 1]  # null outcome -> 0 (Q1/Q2)
    d = dose_measures(df, S.TREATMENT_PARTS, ["EXERHMM1_MIN", "EXERHMM2_MIN"]).orderBy("_SEQNO").collect()
    assert d[0].TOTAL_EXERCISE_MINUTES == 1800.0 and d[0].EXERCISE_INTENSITY_PER_SESSION == 1800.0
    assert d[2].EXERCISE_CATEGORY == "None" and d[0].EXERCISE_CATEGORY == "High"


HTML = """<html><body>
<b>x</b>Label:&nbsp;Sex of Respondent<br>Section&nbsp;Name:&nbsp;Respondent Sex (core)<br>
SAS&nbsp;Variable&nbsp;Name:&nbsp;SEXVAR<br><table><tr><td>1</td><td>Male</td></tr>
<tr> <td class="a">2</td><td>Female&amp;co</td></tr><tr><td></td><td>blank</td></tr></table>
Label:&nbsp;Ever told depression<br>Section&nbsp;Name:&nbsp;Demographics (module)<br>
SAS&nbsp;Variable&nbsp;Name:&nbsp;ADDEPEV3<br><table><tr><td>1</td><td>Yes</td></tr></table></body></html>"""


def test_codebook_metadata_and_sections(spark):
    pages = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    meta = survey_metadata(pages)
    rows = sorted((r["SAS Variable Name"], r["Value"], r["Value Label"]) for r in meta.collect())
    assert rows == [("ADDEPEV3", "1", "Yes"), ("SEXVAR", "1", "Male"), ("SEXVAR", "2", "Female&co")]
    # "Respondent Sex (core)" cleans to "respondent_sex", which is not in the (separator-free) list of
    # sections of interest -- the reference behaves the same way; "Demographics (module)" is kept.
    sections = {r["SAS Variable Name"]: r["Section Name Clean"] for r in clean_section_names(meta).collect()}
    assert sections == {"ADDEPEV3": "demographics"}
