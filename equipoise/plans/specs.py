"""Confounder sets x (caliper, ratio) settings, with one result row per setting and the balance of each covariate.

All specifications go through the same jobs: their logistic models are fitted together, their scores are matched by one
ranking and one rank join, and balance, effect and AUC are aggregates grouped by specification.  A specification's rows are
its complete cases, so each is prepared on its own and the narrow results are stacked: (spec, id, arm, outcome, confounders).
The driver loops over configurations, never over rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equipoise.operators import balance as B
from equipoise.operators import propensity as P
from equipoise.operators.columns import category_codes, interaction_terms
from equipoise.operators.logistic import fit_logistics
from equipoise.operators.matching import match_scores, matched_sides
from equipoise.operators.scaling import standardize
from equipoise.plans import survey_config as S
from equipoise.plans.matching import prepare
from equipoise.session import join_small, reliable_checkpoint

SPEC_KEYS = ["spec_name", "caliper", "ratio"]


@dataclass
class SpecTest:
    """Results of a specification test.

    ``results``: one row per specification and setting that found a match (Q19).  ``balance``: one row per covariate of each:
    means of both matched sides and the standardised difference.
    """

    results: DataFrame
    balance: DataFrame


def _slots(n: int) -> list[str]:
    return [f"x{i}" for i in range(n)]


def evaluate(stacked: DataFrame, variables: Mapping[str, Sequence[str]], grid: Sequence[tuple], algorithm: str = "nearest") -> SpecTest:
    """Matching, balance, effect and AUC of every specification and setting.

    ``stacked``: (spec, id, t, y, ps, x0 ..): a specification's rows with its score and, in the order of
    ``variables[spec]``, its confounders.
    """
    session, specs = stacked.sparkSession, list(variables)
    scores = {s: f"ps{i}" for i, s in enumerate(specs)}
    wide = stacked.select("id", "t", *[F.when(F.col("spec") == s, F.col("ps")).alias(c) for s, c in scores.items()])
    pairs = reliable_checkpoint(match_scores(wide, scores, "t", "id", grid))
    matches = pairs.groupBy("spec", "setting").agg(F.count(F.lit(1)).alias("n_matches"))

    sides = matched_sides(stacked.withColumnRenamed("spec", "own"), pairs, "id", "t").where("own = spec").drop("own")
    slots = _slots(max(len(v) for v in variables.values()))
    # the outcome is one more measured column: its means' difference is the effect
    measured = reliable_checkpoint(B.balance(sides, [*slots, "y"], "t", by=["spec", "setting"]))
    names = session.createDataFrame([(s, x, v) for s, vs in variables.items() for x, v in zip(_slots(len(vs)), vs)],
                                    "spec string, slot string, name string")
    settings = session.createDataFrame([(i, float(c), int(r)) for i, (c, r) in enumerate(grid)], "setting int, caliper double, ratio int")
    many = len(specs) * len(grid) * (len(slots) + 1)
    by_covariate = join_small(names, measured.withColumnRenamed("variable", "slot"), ["spec", "slot"], known_rows=many)
    balance = by_covariate.join(F.broadcast(settings), "setting").select(
        F.col("spec").alias("spec_name"), "caliper", "ratio", F.col("name").alias("variable"), "treated_mean", "control_mean", "smd")
    average = by_covariate.groupBy("spec", "setting").agg(F.avg(F.abs("smd")).alias("avg_abs_std_diff"))
    effect = measured.where("variable = 'y'").select(
        "spec", "setting", (F.col("treated_mean") - F.col("control_mean")).alias("treatment_effect"))

    t = F.col("t") == 1
    arms = stacked.groupBy("spec").agg(F.count(F.when(t, 1)).alias("n_treated"), F.count(F.when(~t, 1)).alias("n_control"))
    auc = P.auc(stacked, "ps", "t", by=["spec"], groups_bound=len(specs)).select("spec", "auc")
    sizes = session.createDataFrame([(s, len(v)) for s, v in variables.items()], "spec string, n_confounders int")
    of_spec = sizes.join(arms, "spec").join(auc, "spec", "left")
    results = matches.join(average, ["spec", "setting"]).join(effect, ["spec", "setting"]).join(of_spec, "spec").join(
        F.broadcast(settings), "setting").select(
        F.col("spec").alias("spec_name"), "caliper", "ratio", F.lit(algorithm).alias("algorithm"), "n_confounders", "n_treated",
        "n_control", "n_matches", "auc", "avg_abs_std_diff", "treatment_effect")
    return SpecTest(results, balance)


def spec_test_with_scores(scored: DataFrame, specs: Mapping[str, str], confounders: Sequence[str] | Mapping[str, Sequence[str]],
                          id_col: str, treatment: str, outcome: str, grid: Sequence[tuple] = S.SPEC_GRID) -> SpecTest:
    """G2 with supplied scores: ``specs`` maps a spec name -> score column; ``confounders`` may differ by spec."""
    variables = {s: list(confounders[s] if isinstance(confounders, Mapping) else confounders) for s in specs}
    parts = [scored.select(F.lit(s).alias("spec"), F.col(id_col).alias("id"), F.col(treatment).alias("t"), F.col(outcome).alias("y"),
                           F.col(column).cast("double").alias("ps"), *_columns(variables[s], variables)) for s, column in specs.items()]
    return evaluate(reliable_checkpoint(reduce(DataFrame.unionByName, parts)), variables, grid)


def _columns(own: Sequence[str], variables: Mapping[str, Sequence[str]]) -> list:
    """A specification's confounders in the slots that the longest one needs."""
    slots = _slots(max(len(v) for v in variables.values()))
    padded = [*own, *[None] * (len(slots) - len(own))]
    return [(F.lit(None) if v is None else F.col(f"`{v}`")).cast("double").alias(x) for v, x in zip(padded, slots)]


def spec_comparison_with_scores(spark: SparkSession, scored: DataFrame, specs: dict, confounders: Sequence[str],
                                id_col: str, treatment: str, outcome: str,
                                grid: Sequence[tuple] = S.SPEC_GRID) -> DataFrame:
    """The ``results`` of ``spec_test_with_scores``."""
    return spec_test_with_scores(scored, specs, confounders, id_col, treatment, outcome, grid).results


def spec_test(df: DataFrame, specs: Mapping[str, Sequence[str]], id_col: str, treatment: str, outcome: str,
              categorical: Sequence[str] = (), grid: Sequence[tuple] = S.SPEC_GRID, rf_params: dict | None = None) -> SpecTest:
    """For every confounder set fit logistic + forest, keep the better AUC, then run every setting.

    All logistic models are fitted together, each step in one reading of the stacked rows.  A forest that can't be fitted to
    a specification's rows leaves the logistic model; a specification without complete cases gives no rows.
    """
    for name, confounders in specs.items():
        if missing := [c for c in confounders if c not in df.columns]:
            raise ValueError(f"specification {name!r} names confounders that the table lacks: {missing}")
    # what builds the table, its joins too, runs once and not for every reading of every specification
    df = reliable_checkpoint(df.select(*dict.fromkeys([id_col, treatment, outcome, *(c for v in specs.values() for c in v)])))
    slots, parts = _slots(max(len(v) for v in specs.values())), []
    for name, confounders in specs.items():
        analysis = prepare(df, id_col, treatment, outcome, confounders, categorical)
        std = standardize(analysis, confounders, suffix="_z")
        z = [F.col(f"`{c}_z`").alias(f"z{i}") for i, c in enumerate(confounders)]
        z += [F.lit(None).cast("double").alias(f"z{i}") for i in range(len(confounders), len(slots))]
        parts.append(std.select(F.lit(name).alias("spec"), F.col(id_col).alias("id"), F.col(treatment).alias("t"),
                                F.col(outcome).alias("y"), *_columns(confounders, specs), *z))
    rows = reliable_checkpoint(reduce(DataFrame.unionByName, parts))
    there = {r["spec"] for r in rows.select("spec").distinct().collect()}
    variables = {s: list(v) for s, v in specs.items() if s in there}
    if not variables:
        raise ValueError("no specification has a complete case")
    features = {s: [f"z{i}" for i in range(len(v))] for s, v in variables.items()}
    logistic = fit_logistics(rows, features, "t", of_set="spec")
    scored = None
    for name in variables:
        own = rows.where(F.col("spec") == name)
        both = own.withColumn("ps_logistic", logistic[name].probability())
        try:
            forest = P.fit_random_forest(own, features[name], "t", **(rf_params or S.RF_MAIN))
            both = P.score(forest, both, features[name], "ps_forest")
        except IllegalArgumentException:
            both = both.withColumn("ps_forest", F.lit(None).cast("double"))
        scored = both if scored is None else scored.unionByName(both)
    # one reading scores all rows, and one aggregate ranks the models of all specifications
    scored = reliable_checkpoint(scored.drop(*[f"z{i}" for i in range(len(slots))]))
    long = scored.select("spec", "t", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("ps"))
                                                         for m in ("ps_logistic", "ps_forest")])))
    found = {(r["spec"], r["model"]): r["auc"] or 0.0
             for r in P.auc(long, "ps", "t", by=["spec", "model"], groups_bound=2 * len(variables)).collect()}
    better = [s for s in variables if found.get((s, "ps_forest"), 0.0) > found.get((s, "ps_logistic"), 0.0)]
    chosen = scored.withColumn("ps", F.when(F.col("spec").isin(better), F.col("ps_forest")).otherwise(F.col("ps_logistic")))
    return evaluate(chosen.drop("ps_logistic", "ps_forest"), variables, grid)


def spec_grid(df: DataFrame, specs: dict, id_col: str, treatment: str, outcome: str, categorical: Sequence[str] = (),
              grid: Sequence[tuple] = S.SPEC_GRID, rf_params: dict | None = None) -> DataFrame:
    """The ``results`` of ``spec_test``."""
    return spec_test(df, specs, id_col, treatment, outcome, categorical, grid, rf_params).results


def with_survey_interactions(df: DataFrame) -> DataFrame:
    """B21 on a processed survey: numeric codes (``_NUMERIC``) of its categorical columns, and the three interaction columns.

    A column that the table lacks leaves out what needs it; the age of a table without one is the fixed proxy.
    """
    own = [c for c in S.INTERACTION_CATEGORIES if c in df.columns]
    coded = category_codes(df, own, suffix="_NUMERIC") if own else df
    terms = {name: pair for name, pair in S.INTERACTIONS.items()
             if all(not isinstance(c, str) or c in coded.columns for c in pair)}
    return interaction_terms(coded, terms)


def with_config_label(results: DataFrame) -> DataFrame:
    """L4: ``label`` = spec and matching setting, as the series of a comparison chart are named."""
    setting = F.format_string("caliper=%s, ratio=%d", F.col("caliper").cast("string"), F.col("ratio"))
    return results.withColumn("label", F.concat_ws(" + ", "spec_name", setting))


def best_spec(comparison: DataFrame) -> DataFrame:
    """The setting with the least mean |SMD| (ties: spec name, caliper, ratio)."""
    return comparison.orderBy("avg_abs_std_diff", "spec_name", "caliper", "ratio").limit(1)
