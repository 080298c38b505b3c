"""Preprocessing pipelines -- coded answers -> recoded columns, indices and scaled indices.

Each recode group is a ``DataFrame -> DataFrame`` projection (``withColumns``:
one projection per group, no per-column loop of plans); the min/max of every
index that gets scaled is taken in ONE aggregate at the end (D5), so the whole
stage is one scan, one small aggregate job and one projection.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions import recode as R
from equipoise.functions import rowwise as W
from equipoise.operators.columns import available, drop_available
from equipoise.operators.scaling import minmax_scale_spec
from equipoise.plans import survey_config as S
from equipoise.sources.io import clean_values


def clean_section_names(metadata: DataFrame, col: str = "Section Name", out: str = "Section Name Clean") -> DataFrame:
    """H1 + B3 + D15: clean section names, keep the sections of interest, distinct rows."""
    m = metadata.withColumn(out, R.clean_name(col))
    return m.where(F.col(out).isin(S.SECTIONS_OF_INTEREST)).select("SAS Variable Name", out, "Label").dropDuplicates()


def _ace(df):
    cols = available(df, S.ACE_MAPS)
    df = df.withColumns({c: R.recode(c, S.ACE_MAPS[c]) for c in cols})
    return df.withColumn("ACE_TOTAL", W.row_sum(cols))


def _alcohol(df):
    parts = [W.frequency_part("ALCDAY4", S.ALCOHOL_WEEKS_PER_MONTH, S.ALCOHOL_FREQ_DIVISOR)]
    parts += [W.scaled_part(c, lo, hi, div) for c, (lo, hi, div) in S.ALCOHOL_PARTS.items()]
    # parts as columns: the mean names each several times, and inlined they outgrow generated code
    named = {f"_part_{i}": p for i, p in enumerate(parts)}
    return df.withColumns(named).withColumn("ALCOHOL_SEVERITY", W.row_mean(list(named))).drop(*named)


def _demographics(df):
    new = {c: R.recode(c, m) for c, m in S.LABEL_MAPS.items() if c in df.columns and c != "ADDEPEV3"}
    if "CHILDREN" in df.columns:
        new["CHILDREN"] = R.recode_range_as_text("CHILDREN", *S.CHILDREN_RANGE, extra=S.CHILDREN_EXTRA)
    for c in ("WEIGHT2", "HEIGHT3"):
        if c in df.columns:
            new[c] = R.null_codes(c, S.WEIGHT_HEIGHT_SPECIAL)
    return df.withColumns(new)


def _disability(df):
    cols = available(df, S.DISABILITY_VARS)
    df = df.withColumns({f"{c}_bin": R.indicator(c) for c in cols})
    total = sum((F.col(f"{c}_bin") for c in cols), F.lit(0))
    return df.withColumns({"DISABILITY_INDEX": total,
                           "DISABILITY_INDEX_NORMALIZED": total / F.lit(float(len(S.DISABILITY_VARS)))})


def _geography(df):
    return df.withColumns({out: R.recode(src, m) for out, (src, m) in S.GEO_MAPS.items()})


def _health(df):
    return df.withColumn("ADDEPEV3", R.recode("ADDEPEV3", S.LABEL_MAPS["ADDEPEV3"]))


def _substances(df):
    df = df.withColumns({c: R.recode(c, m) for c, m in S.SMOKING_MAPS.items()})
    df = df.withColumn("SMOKING_INDEX", W.row_mean(list(S.SMOKING_MAPS)))
    lo, hi = S.MARIJUANA_DAYS
    df = df.withColumn("MARIJAN1", R.in_range_or_zero("MARIJAN1", lo, hi, scale=None))
    return df.withColumn("MARIJUANA_INDEX_NORMALIZED", F.col("MARIJAN1") / F.lit(float(hi)))


def _orientation(df):
    return df.withColumn("SEXUAL_ORIENTATION_SCORE", R.first_non_null_score("SOMALE", "SOFEMALE", S.ORIENTATION_MAP))


def _social(df):
    mapped = {c: R.recode(c, m) for c, m in S.SOCIAL_MAPS.items() if c in df.columns}
    df = df.withColumns({f"_score_{c}": e for c, e in mapped.items()})
    new = {}
    for name, weights in S.SOCIAL_INDEX_WEIGHTS.items():
        present = [(f"_score_{c}", w) for c, w in weights.items() if c in mapped]
        new[f"{name.upper()}_INDEX"] = W.weighted_mean(present) if present else F.lit(None).cast("double")
    return df.withColumns(new).drop(*[f"_score_{c}" for c in mapped])


def _access(df):
    df = df.withColumns({c: R.recode(c, m) for c, m in S.ACCESS_MAPS.items()})
    return df.withColumn("HEALTHCAREACCESS_INDEX_WEIGHTED", W.weighted_mean(S.ACCESS_WEIGHTS))


def _mental(df):
    return df.withColumn("MENTHLTH_MAPPED", R.day_scale("MENTHLTH", S.MENTAL_SPECIAL, S.MENTAL_TOP))


def _exercise(df):
    return df.withColumns({
        "STRENGTH_WEEKLY": R.weekly_rate("STRENGTH", S.EXERCISE_WEEKS_PER_MONTH, S.STRENGTH_NEVER_CODE),
        "EXEROFT1_WEEKLY": R.weekly_rate("EXEROFT1", S.EXERCISE_WEEKS_PER_MONTH),
        "EXEROFT2_WEEKLY": R.weekly_rate("EXEROFT2", S.EXERCISE_WEEKS_PER_MONTH),
        "EXRACT12_ACTIVITY": R.recode("EXRACT12", S.ACTIVITY_MAP),
        "EXRACT22_ACTIVITY": R.recode("EXRACT22", S.ACTIVITY_MAP),
        "EXRACT12_AEROBIC": R.member_flag("EXRACT12", S.AEROBIC_CODES),
        "EXRACT22_AEROBIC": R.member_flag("EXRACT22", S.AEROBIC_CODES),
        "EXERHMM1_MIN": R.minutes("EXERHMM1"),
        "EXERHMM2_MIN": R.minutes("EXERHMM2"),
    })


SURVEY_STEPS = [_ace, _alcohol, _demographics, _disability, _geography, _health, _substances,
                _orientation, _social, _access, _mental, _exercise]


def survey_preprocess(raw: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The reference's 12 recode groups in order, one aggregate for all scaled indices, raw columns dropped.

    ``keep`` names further columns, as a row id, that go along unchanged.
    """
    df = clean_values(raw.select(*available(raw, [*keep, *S.TARGET_VARIABLES])))
    df = reduce(lambda acc, step: step(acc), SURVEY_STEPS, df)
    scale = {"ACE_TOTAL": ("ACE_NORMALIZED", "sklearn"),
             "ALCOHOL_SEVERITY": ("ALCOHOL_SEVERITY_NORMALIZED", "sklearn"),
             "SMOKING_INDEX": ("SMOKING_INDEX_NORMALIZED", "null"),
             "HEALTHCAREACCESS_INDEX_WEIGHTED": ("HEALTHCAREACCESS_INDEX_NORMALIZED", "null")}
    for name in S.SOCIAL_INDEX_WEIGHTS:
        scale[f"{name.upper()}_INDEX"] = (f"{name.upper()}_INDEX_NORMALIZED", "zero")
    df = minmax_scale_spec(df, scale)
    # blank labels are missing from here on, whether or not the result goes through a file
    return clean_values(drop_available(df, S.DROP_COLUMNS))


# ---- the same building blocks configured for the ``coded`` fixture --------------------

CODED_YESNO = {1: 1, 2: 0, 7: None, 9: None}
CODED_SCALE5 = {1: 0, 2: 0.25, 3: 0.5, 4: 0.75, 5: 1, 7: None, 9: None}
CODED_WEIGHTS = {"yesno_score": 0.4, "scale5_score": 0.6}


CODED_SCALE = {"score_total": ("score_total_normalized", "sklearn"),
               "combo_index": ("combo_index_normalized", "zero"),
               "severity": ("severity_normalized", "null")}
CODED_RAW = ["yesno", "scale5", "freq", "duration", "days30", "weight", "part_a", "part_b", "text_num"]


def coded_recodes(coded: DataFrame) -> DataFrame:
    """The stateless part of J13 on ``coded`` (row-wise recodes and indices; runs on streams too)."""
    df = coded.withColumns({
        "yesno_score": R.recode("yesno", CODED_YESNO),
        "scale5_score": R.recode("scale5", CODED_SCALE5),
        "freq_weekly": R.weekly_rate("freq", 4.345, never_code=888),
        "duration_min": R.minutes("duration"),
        "days30_mapped": R.day_scale("days30", (77, 88, 99), 30),
        "days30_or_zero": R.in_range_or_zero("days30", 1, 30, 30.0),
        "weight_clean": R.null_codes("weight", [7777, 9999]),
        "pair_score": R.first_non_null_score("part_a", "part_b", {1: 1, 3: 0.5}),
        "flag_index": R.flag_index(["yesno", "part_a", "part_b"]),
        "scale5_member": R.member_flag("scale5", [1, 2, 4, 5, 7]),
        "text_value": R.to_number(R.blank_as_null("text_num")),
        "severity": W.row_mean([W.frequency_part("freq", 4.3, 30), W.scaled_part("scale5", 1, 76, 15),
                                W.scaled_part("days30", 1, 76, 30), W.scaled_part("weight", 1, 76, 15)]),
    })
    return df.withColumns({"score_total": W.row_sum(["yesno_score", "scale5_score"]),
                           "combo_index": W.weighted_mean(CODED_WEIGHTS)})


def coded_preprocess(coded: DataFrame, extremes: dict | None = None) -> DataFrame:
    """J13 on the ``coded`` fixture: every recode kind once, two indices, one scaling aggregate.

    ``extremes`` (column -> (min, max)) fixes the scaling instead of measuring it,
    e.g. for a stream scaled like a reference batch.
    """
    df = minmax_scale_spec(coded_recodes(coded), CODED_SCALE, extremes)
    return drop_available(df, CODED_RAW)
