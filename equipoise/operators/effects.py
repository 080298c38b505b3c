"""Effect estimators.

Regressions with one predictor are closed forms over mergeable weighted moments (``moments``),
so each reads its rows once -- no model object, no collect of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.functions.recode import finite_or_null
from equipoise.functions.student import t_two_sided
from equipoise.operators.balance import weighted_balance
from equipoise.operators.moments import merged_moments, moments, partial_moments

Z95 = 1.96


def treatment_effect(df: DataFrame, outcome: str, treatment: str) -> DataFrame:
    """D3: difference in means with SE = sqrt(sT^2/nT + sC^2/nC) and a 95% interval, long form (metric, value)."""
    t = F.col(treatment) == 1
    c = F.col(treatment) == 0
    y = F.col(outcome).cast("double")
    s = df.agg(
        F.avg(F.when(t, y)).alias("mt"), F.avg(F.when(c, y)).alias("mc"),
        F.stddev_samp(F.when(t, y)).alias("st"), F.stddev_samp(F.when(c, y)).alias("sc"),
        F.count(F.when(t, F.lit(1))).alias("nt"), F.count(F.when(c, F.lit(1))).alias("nc"),
    )
    s = s.withColumn("ate", F.col("mt") - F.col("mc")).withColumn(
        "se", F.sqrt((F.col("st") / F.sqrt("nt")) ** 2 + (F.col("sc") / F.sqrt("nc")) ** 2))
    return s.selectExpr(
        "stack(6, 'Treated Outcome', mt, 'Control Outcome', mc, 'Treatment Effect', ate, 'SE', se, "
        f"'CI Lower', ate - {Z95} * se, 'CI Upper', ate + {Z95} * se) AS (metric, value)")


def weighted_treatment_effect(df: DataFrame, outcome: str, treatment: str, weight: str) -> DataFrame:
    """D3 with row weights: difference in weighted means, SE from the weighted variances over the effective sizes."""
    b = weighted_balance(df, [outcome], treatment, weight)
    b = b.withColumn("ate", F.col("treated_mean") - F.col("control_mean")).withColumn(
        "se", F.sqrt(F.col("treated_sd") ** 2 / F.col("treated_ess") + F.col("control_sd") ** 2 / F.col("control_ess")))
    return b.selectExpr(
        "stack(8, 'Treated Outcome', treated_mean, 'Control Outcome', control_mean, 'Treatment Effect', ate, 'SE', se, "
        f"'CI Lower', ate - {Z95} * se, 'CI Upper', ate + {Z95} * se, 'Treated ESS', treated_ess, 'Control ESS', control_ess) "
        "AS (metric, value)")


def ipw_weights(df: DataFrame, score: str, treatment: str, out: str = "ipw_weight") -> DataFrame:
    """ATE weight T/ps + (1-T)/(1-ps); rows with a missing or infinite weight are dropped."""
    ps = F.col(score).cast("double")
    w = F.when(F.col(treatment) == 1, F.try_divide(F.lit(1.0), ps)).otherwise(F.try_divide(F.lit(1.0), 1 - ps))
    return df.withColumn(out, finite_or_null(w)).where(F.col(out).isNotNull())


#: a predictor whose spread is below this share of its largest value counts as constant
_ZERO_SPREAD = 4e-16


def _slope(m: DataFrame) -> DataFrame:
    """Weighted moments (``moments``) with intercept a, slope b, their errors se_a and se_b, r2 and the residuals' degrees of freedom."""
    spread = F.col("largest") * _ZERO_SPREAD
    m = m.withColumn("sxx", F.when(F.col("sxx") > F.col("w") * spread * spread, F.col("sxx")))
    m = m.withColumn("b", F.try_divide(F.col("sxy"), F.col("sxx")))
    m = m.withColumns({"a": F.col("my") - F.col("b") * F.col("mx"), "dof": (F.col("n") - 2).cast("double"),
                       "rss": F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.col("b") * 0.0)})
    m = m.withColumn("s2", F.try_divide(F.col("rss"), F.when(F.col("dof") > 0, F.col("dof"))))
    return m.withColumns({
        "se_b": F.sqrt(F.try_divide(F.col("s2"), F.col("sxx"))),
        "se_a": F.sqrt(F.col("s2") * (F.try_divide(F.lit(1.0), F.col("w")) + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx")))),
        "r2": 1 - F.try_divide(F.col("rss"), F.col("syy"))})


def wls(df: DataFrame, y: str, x: str, weight: str) -> DataFrame:
    """Weighted least squares ``y ~ 1 + x``: per term coefficient, SE, t, two-sided p; model R^2 and n.

    Matches statsmodels' WLS (residual scale RSS_w / (n - 2), weighted centred TSS for R^2).  The rows are read once, into
    centred moments, so that a large offset of x or y costs no precision.  A constant x, or weights that add up to 0, give
    NULL; without rows there is one of NULLs per term.
    """
    found = moments(df, x, y, weight)
    one = df.sparkSession.range(1).select(F.lit(0).alias("_one"))
    m = one.join(found.withColumn("_one", F.lit(0)), "_one", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    terms = _slope(m).selectExpr(f"stack(2, 'Intercept', a, se_a, '{x}', b, se_b) AS (term, coef, se)", "r2", "n", "dof")
    t = F.try_divide(F.col("coef"), F.col("se"))
    return terms.select("term", "coef", "se", t.alias("t_stat"), t_two_sided(t, F.col("dof")).alias("p_value"),
                        F.col("r2").alias("r_squared"), "n")


def subgroup_effects(df: DataFrame, y: str, treatment: str, weight: str, subgroups: dict,
                     min_size: int = 50) -> DataFrame:
    """WLS effect of a binary treatment inside each level of each subgroup column, with SE, t and two-sided p.

    ``subgroups`` maps a display name -> column.  The rows are read once, into the moments of each cell of all subgroup
    columns; the levels of each column are merged from the cells, so no row is multiplied.  Levels with fewer than
    ``min_size`` rows are skipped (B25); a level with one arm only gives a NULL effect (Q17).
    """
    names, columns = list(subgroups), list(subgroups.values())
    frame = df.select(*[F.col(f"`{c}`").cast("string").alias(f"g{i}") for i, c in enumerate(columns)],
                      *[F.col(f"`{c}`").alias(a) for c, a in ((treatment, "_t"), (y, "_y"), (weight, "_w"))])
    cells = partial_moments(frame, "_t", "_y", "_w", [f"g{i}" for i in range(len(columns))])
    levels = F.array(*[F.struct(F.lit(n).alias("subgroup"), F.col(f"g{i}").alias("category")) for i, n in enumerate(names)])
    of_level = cells.withColumn("_level", F.explode(levels)).select("_level.*", "n", "w", "mx", "my", "sxx", "sxy", "syy", "largest")
    m = merged_moments(of_level.where(F.col("category").isNotNull()), ["subgroup", "category"]).where(F.col("n") >= min_size)
    t = F.try_divide(F.col("b"), F.col("se_b"))
    return _slope(m).select("subgroup", "category", F.col("b").alias("effect"), F.col("n").alias("sample_size"),
                            F.col("se_b").alias("se"), t.alias("t_stat"), t_two_sided(t, F.col("dof")).alias("p_value"))


def weighted_bin_stats(df: DataFrame, bin_col: str, y: str, weight: str, extra_keys: Sequence[str] = ()) -> DataFrame:
    """Per bin weighted mean, SE = sqrt(weighted variance / n), count and 95% interval, from one reading of the rows.

    Rows without a bin, y or weight don't count; bins with no rows or zero weight are dropped.
    """
    keys = [bin_col, *extra_keys]
    m = moments(df.where(F.col(bin_col).isNotNull()), y, y, weight, keys).where("w != 0")
    se = F.sqrt(F.col("syy") / F.col("w") / F.col("n"))
    return m.select(*keys, F.col("my").alias("mean"), se.alias("se"), F.col("n").alias("count")).select(
        *keys, "mean", "se", "count", (F.col("mean") - Z95 * F.col("se")).alias("ci_lower"),
        (F.col("mean") + Z95 * F.col("se")).alias("ci_upper"))


def trend_line(model: DataFrame, xmin: float, xmax: float, x_term: str, points: int = 100) -> DataFrame:
    """Fitted line a + b*x on ``points`` evenly spaced x (np.linspace), from a ``wls`` result.

    The two coefficients are scalars (read once, like a fitted model's parameters); the
    grid is ``spark.range(points)``.
    """
    spark = model.sparkSession
    coef = model.groupBy().agg(F.max(F.when(F.col("term") == "Intercept", F.col("coef"))).alias("a"),
                               F.max(F.when(F.col("term") == x_term, F.col("coef"))).alias("b")).first()
    a = F.lit(coef["a"]).cast("double")
    b = F.lit(coef["b"]).cast("double")
    step = (xmax - xmin) / (points - 1)
    x = F.when(F.col("id") == points - 1, F.lit(float(xmax))).otherwise(F.col("id") * F.lit(step) + F.lit(float(xmin)))
    return spark.range(points).select(F.col("id").alias("point"), x.alias("x")).withColumn(
        "y_hat", a + b * F.col("x"))
