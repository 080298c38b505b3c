"""Propensity-score matching analysis as a chain of DataFrame operators.

load -> define variables -> prepare (complete cases, category codes) -> score ->
balance before -> match -> matched cohort -> balance after -> effect -> save.
Intermediate frames that several steps reuse (``analysis``, ``scored``, ``pairs``,
``matched``) are written once to the shared checkpoint folder, so no cache has to be
released and a lost executor loses nothing; results stay DataFrames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.recode import any_positive, threshold_flag
from equipoise.operators import balance as B
from equipoise.operators import effects as E
from equipoise.operators import propensity as P
from equipoise.operators.columns import available, category_codes, complete_cases
from equipoise.operators.matching import match_nearest, matched_cohort
from equipoise.operators.scaling import standardize
from equipoise.plans import survey_config as S
from equipoise.session import reliable_checkpoint
from equipoise.sources.io import clean_values, with_row_id, write_result


def define_survey_variables(df: DataFrame, id_col: str = "_SEQNO") -> DataFrame:
    """B6 + B7 (+ A5): exercise treatment flag, mental-health outcome flag, a row id when missing."""
    df = clean_values(df)
    if id_col not in df.columns:  # unique ids 0..n-1; the order is that of Spark's splits, not of the files
        df = with_row_id(reliable_checkpoint(df.withColumn("_pos", F.monotonically_increasing_id())), id_col, ["_pos"]).drop("_pos")
    return df.withColumns({
        "_EXERCISE_BINARY": any_positive(S.TREATMENT_PARTS),
        "_MENTAL_HEALTH_BINARY": threshold_flag(S.OUTCOME_SOURCE, S.OUTCOME_THRESHOLD),
    })


def prepare(df: DataFrame, id_col: str, treatment: str, outcome: str | None, confounders: Sequence[str],
            categorical: Sequence[str] = ()) -> DataFrame:
    """B4 -> B15 -> B16 -> B4: complete cases, categorical codes (computed on the filtered rows), numeric."""
    cols = [id_col, treatment] + ([outcome] if outcome else []) + list(confounders)
    base = complete_cases(clean_values(df.select(*cols)))
    cats = [c for c in categorical if c in confounders]
    coded = category_codes(base, cats) if cats else base
    coded = coded.withColumns({c: F.col(c).try_cast("double") for c in confounders})
    return complete_cases(coded, list(confounders))


class MatchingAnalysis:
    """Fluent matcher over any table with an id, a 0/1 treatment, an outcome and confounders."""

    def __init__(self, df: DataFrame, id_col: str, treatment: str, outcome: str, confounders: Sequence[str],
                 categorical: Sequence[str] = ()):
        self.df = df
        self.id_col, self.treatment, self.outcome = id_col, treatment, outcome
        self.confounders = available(df, confounders)
        self.categorical = list(categorical)
        self.analysis = self.scored = self.pairs = self.matched = None
        self.model = None
        self.score_col = "propensity_score"

    def prepare(self) -> "MatchingAnalysis":
        self.analysis = reliable_checkpoint(prepare(self.df, self.id_col, self.treatment, self.outcome, self.confounders,
                                                    self.categorical))
        return self

    def use_scores(self, score_col: str) -> "MatchingAnalysis":
        """Take a score column already present (e.g. from another model) instead of fitting one."""
        if self.analysis is None:
            self.prepare()
        self.scored = self.analysis.withColumn(self.score_col, F.col(score_col).cast("double"))
        return self

    def fit_scores(self, model: str = "random_forest", rf_params: dict | None = None) -> "MatchingAnalysis":
        """J1 + J2 (or J3): standardised confounders -> fitted P(treated)."""
        if self.analysis is None:
            self.prepare()
        std = standardize(self.analysis, self.confounders, suffix="_z")
        feats = [c + "_z" for c in self.confounders]
        if model == "logistic":
            self.model = P.fit_logistic(std, feats, self.treatment)
        else:
            self.model = P.fit_random_forest(std, feats, self.treatment, **(rf_params or S.RF_MAIN))
        self.scored = reliable_checkpoint(P.score(self.model, std, feats, self.score_col).drop(*feats))
        return self

    def auc(self) -> DataFrame:
        return P.auc(self.scored, self.score_col, self.treatment)

    def feature_importance(self) -> DataFrame:
        return P.feature_importance(self.model, self.confounders, self.df.sparkSession)

    def balance_before(self) -> DataFrame:
        return B.balance(self.scored, self.confounders, self.treatment)

    def match(self, caliper: float = S.MAIN_CALIPER, ratio: int = S.MAIN_RATIO) -> "MatchingAnalysis":
        self.pairs = reliable_checkpoint(
            match_nearest(self.scored, self.score_col, self.treatment, self.id_col, caliper, ratio))
        self.matched = reliable_checkpoint(matched_cohort(self.scored, self.pairs, self.id_col))
        return self

    def balance_after(self) -> DataFrame:
        return B.balance(self.matched, self.confounders, self.treatment)

    def effect(self) -> DataFrame:
        return E.treatment_effect(self.matched, self.outcome, self.treatment)

    def sample_sizes(self) -> DataFrame:
        return B.sample_sizes({"before": self.scored, "after": self.matched}, self.treatment)

    def save(self, base_path: str, fmt: str = "csv") -> None:
        """A4: matched cohort, pairs, balance tables and effect written as result tables."""
        write_result(self.matched, f"{base_path}/matched", fmt)
        write_result(self.pairs, f"{base_path}/matching_pairs", fmt)
        write_result(self.balance_before(), f"{base_path}/balance_before_matching", fmt)
        write_result(self.balance_after(), f"{base_path}/balance_after_matching", fmt)
        write_result(self.effect(), f"{base_path}/treatment_effect_results", fmt)

    def run(self, caliper: float = S.MAIN_CALIPER, ratio: int = S.MAIN_RATIO, model: str = "random_forest",
            score_col: str | None = None) -> "MatchingAnalysis":
        self.prepare()
        if score_col:
            self.use_scores(score_col)
        else:
            self.fit_scores(model)
        return self.match(caliper, ratio)
