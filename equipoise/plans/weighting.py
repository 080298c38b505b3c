"""Inverse-probability-weighting analysis -- dose measures, scores, weights, dose-response, subgroups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.recode import any_positive, fixed_bins
from equipoise.functions.rowwise import row_sum
from equipoise.operators import effects as E
from equipoise.operators import propensity as P
from equipoise.operators.bins import equal_width_bins, width_bins
from equipoise.operators.columns import available, category_codes, complete_cases, decode_categories
from equipoise.operators.scaling import column_extremes, standardize
from equipoise.plans import survey_config as S
from equipoise.session import reliable_checkpoint
from equipoise.sources.io import clean_values, write_result


def dose_measures(df: DataFrame, weekly: Sequence[str], minutes: Sequence[str], cap: float = 7.0,
                  prefix: str = "EXERCISE") -> DataFrame:
    """Total days (NULL as 0), total minutes, capped frequency, minutes per active part, volume, category."""
    total_days = row_sum(weekly)
    total_min = row_sum(minutes)
    sessions = sum((F.coalesce(F.col(c) > 0, F.lit(False)).cast("int") for c in weekly), F.lit(0))
    freq = F.least(total_days, F.lit(float(cap)))
    out = df.withColumns({
        f"TOTAL_{prefix}_DAYS": total_days,
        f"TOTAL_{prefix}_MINUTES": total_min,
        f"{prefix}_FREQUENCY": freq,
        f"{prefix}_INTENSITY_PER_SESSION": F.when(sessions > 0, total_min / sessions).otherwise(F.lit(0.0)),
    })
    out = out.withColumn(f"{prefix}_VOLUME", F.col(f"{prefix}_FREQUENCY") * F.col(f"{prefix}_INTENSITY_PER_SESSION"))
    return out.withColumn(f"{prefix}_CATEGORY", fixed_bins(f"{prefix}_FREQUENCY", S.EXERCISE_CATEGORY_EDGES,
                                                           S.EXERCISE_CATEGORY_LABELS))


class WeightingAnalysis:
    """IPW analysis of a 0/1 treatment, a continuous outcome and a dose column, with subgroup effects."""

    def __init__(self, df: DataFrame, id_col: str, treatment: str, outcome: str, dose: str,
                 confounders: Sequence[str], categorical: Sequence[str] = (), subgroups: dict | None = None,
                 required: Sequence[str] = ()):
        self.df = clean_values(df)
        self.id_col, self.treatment, self.outcome, self.dose = id_col, treatment, outcome, dose
        self.confounders = available(df, confounders)
        self.categorical = [c for c in categorical if c in self.confounders]
        self.subgroups = subgroups or {}
        self.required = list(required)
        self.analysis = None
        self.mapping = None

    def scores(self, rf_params: dict | None = None, score_col: str | None = None) -> DataFrame:
        """J2 on the complete cases of (id, treatment, confounders), joined back by id (C2) -> J5 weights.

        The table is written once before: the codes, the moments and the forest read it many times, and what builds it
        may send whole tables to the driver to broadcast them.
        """
        self.df = reliable_checkpoint(self.df)
        if score_col is None:
            ps = complete_cases(self.df.select(self.id_col, self.treatment, *self.confounders))
            if self.categorical:
                ps = category_codes(ps, self.categorical)
            ps = complete_cases(ps.withColumns({c: F.col(c).try_cast("double") for c in self.confounders}))
            std = standardize(ps, self.confounders, suffix="_z")
            feats = [c + "_z" for c in self.confounders]
            model = P.fit_random_forest(std, feats, self.treatment, **(rf_params or S.RF_WEIGHTING))
            ps = P.score(model, std, feats, "propensity_score").select(self.id_col, "propensity_score")
            with_ps = self.df.join(ps, self.id_col, "left")
        else:
            with_ps = self.df.withColumn("propensity_score", F.col(score_col).cast("double"))
        return E.ipw_weights(with_ps, "propensity_score", self.treatment)

    def prepare(self, rf_params: dict | None = None, score_col: str | None = None) -> "WeightingAnalysis":
        weighted = self.scores(rf_params, score_col)
        needed = [*self.required, self.outcome, self.dose, self.treatment, "propensity_score", "ipw_weight",
                  *self.confounders]
        base = complete_cases(weighted, needed)
        if self.categorical:
            base = reliable_checkpoint(base)  # read once a category, and its join sends the scores
            base, self.mapping = category_codes(base, self.categorical, keep_mapping=True)
        # B16 and the second B4: text that isn't a number leaves its row out
        numeric = [c for c in dict.fromkeys([*self.confounders, self.outcome, self.dose])]
        base = complete_cases(base.withColumns({c: F.col(c).try_cast("double") for c in numeric}), numeric)
        self.analysis = reliable_checkpoint(base)
        return self

    def dose_model(self) -> DataFrame:
        """WLS of outcome on dose with IPW weights."""
        return E.wls(self.analysis, self.outcome, self.dose, "ipw_weight")

    def dose_response(self, width: float = S.DOSE_BIN_WIDTH) -> DataFrame:
        """B18 + D9: weighted mean outcome per dose bin."""
        mx = column_extremes(self.analysis, [self.dose])[self.dose][1]
        binned = width_bins(self.analysis, self.dose, width, out="dose_bin", max_value=mx)
        return E.weighted_bin_stats(binned, "dose_bin", self.outcome, "ipw_weight", extra_keys=["dose_bin_start"])

    def dose_curve(self, min_count: int = S.MIN_BIN_COUNT, top: int = S.TOP_BINS) -> DataFrame:
        """B25 + F4: bins with more than ``min_count`` rows, in dose order, first ``top``."""
        return self.dose_response().where(F.col("count") > min_count).orderBy("dose_bin_start").limit(top)

    def trend(self, points: int = 100) -> DataFrame:
        """Fitted dose line over the observed dose range."""
        mn, mx = column_extremes(self.analysis, [self.dose])[self.dose]
        return E.trend_line(self.dose_model(), float(mn), float(mx), self.dose, points)

    def effect(self) -> DataFrame:
        """IPW effect of the treatment (WLS of outcome on the 0/1 treatment)."""
        return E.wls(self.analysis, self.outcome, self.treatment, "ipw_weight")

    def subgroup_effects(self, baseline_labels: Sequence[str] = S.BASELINE_LABELS,
                         min_size: int = S.MIN_SUBGROUP_SIZE) -> DataFrame:
        """D11 over decoded categorical subgroups (C8) plus equal-width outcome bins."""
        frame = self.analysis
        groups = {}
        if self.mapping is not None:
            cats = [c for c in self.subgroups.values() if c in self.categorical]
            frame = decode_categories(frame, self.mapping, cats)
            groups.update({name: (c + "_label" if c in cats else c) for name, c in self.subgroups.items()})
        else:
            groups.update(self.subgroups)
        if baseline_labels:
            frame = equal_width_bins(frame, self.outcome, list(baseline_labels), "_baseline")
            groups["Mental Health Baseline"] = "_baseline"
        return E.subgroup_effects(frame, self.outcome, self.treatment, "ipw_weight", groups, min_size)


    def save(self, base_path: str, fmt: str = "csv") -> None:
        """A4: the analysis rows, dose response, dose model, effect and subgroup effects as result tables."""
        write_result(self.analysis, f"{base_path}/weighted_analysis", fmt)
        write_result(self.dose_response(), f"{base_path}/dose_response", fmt)
        write_result(self.dose_model(), f"{base_path}/dose_model", fmt)
        write_result(self.effect(), f"{base_path}/ipw_effect", fmt)
        write_result(self.subgroup_effects(), f"{base_path}/subgroup_effects", fmt)


def survey_weighting(processed: DataFrame, id_col: str = "_SEQNO") -> WeightingAnalysis:
    """The reference's weighting setup on a processed survey table."""
    df = dose_measures(processed, S.TREATMENT_PARTS, ["EXERHMM1_MIN", "EXERHMM2_MIN"])
    df = df.withColumns({"_EXERCISE_BINARY": any_positive(S.TREATMENT_PARTS),
                         "MENTAL_HEALTH_CONTINUOUS": F.col(S.OUTCOME_SOURCE),
                         "MENTAL_HEALTH_CATEGORY": fixed_bins(S.OUTCOME_SOURCE, S.MENTAL_CATEGORY_EDGES,
                                                              S.BASELINE_LABELS)})
    return WeightingAnalysis(df, id_col, "_EXERCISE_BINARY", "MENTAL_HEALTH_CONTINUOUS", "TOTAL_EXERCISE_MINUTES",
                             S.FULL_MODEL, S.CATEGORICAL_VARS, S.SUBGROUPS,
                             required=["EXERCISE_FREQUENCY", "EXERCISE_INTENSITY_PER_SESSION", "EXERCISE_VOLUME",
                                       "MENTAL_HEALTH_CATEGORY"])
