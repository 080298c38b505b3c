"""Covariate balance.

All covariates are measured in ONE aggregate pass (conditional avg / stddev per
arm), then unpivoted to one row per covariate -- never one job per covariate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.operators.moments import moments


def balance(df: DataFrame, covariates: Sequence[str], treatment: str, pooled: bool = False,
            by: Sequence[str] = ()) -> DataFrame:
    """Per covariate treated mean, control mean and SMD (per group of ``by`` when given).

    SMD = (mean_T - mean_C) / sd_T with the sample sd (n - 1) of the treated arm
    (Q11; ``pooled`` uses sqrt((sd_T^2 + sd_C^2) / 2)); 0 when that sd is not > 0.
    """
    t = F.col(treatment) == 1
    c = F.col(treatment) == 0
    aggs = []
    for i, v in enumerate(covariates):
        x = F.col(v).cast("double")
        aggs += [F.avg(F.when(t, x)).alias(f"tm{i}"), F.avg(F.when(c, x)).alias(f"cm{i}"),
                 F.stddev_samp(F.when(t, x)).alias(f"ts{i}"), F.stddev_samp(F.when(c, x)).alias(f"cs{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    parts = ", ".join(f"'{v}', tm{i}, cm{i}, ts{i}, cs{i}" for i, v in enumerate(covariates))
    long = wide.selectExpr(*by, f"stack({len(covariates)}, {parts}) AS (variable, treated_mean, control_mean, ts, cs)")
    sd = F.sqrt((F.col("ts") ** 2 + F.col("cs") ** 2) / 2) if pooled else F.col("ts")
    smd = F.when(sd > 0, (F.col("treated_mean") - F.col("control_mean")) / sd).otherwise(F.lit(0.0))
    return long.select(*by, "variable", "treated_mean", "control_mean", smd.alias("smd"))


def weighted_balance(df: DataFrame, covariates: Sequence[str], treatment: str, weight: str) -> DataFrame:
    """D1 with row weights (as ``reuse_weights`` gives them): weighted means, SMD and each arm's effective sample size.

    The variance is that of reliability weights, S / (W - sum w^2 / W); the effective size is W^2 / sum w^2.  With
    weights of 1 all of it is ``balance``.  The rows are read once.
    """
    values = F.array(*[F.struct(F.lit(v).alias("variable"), F.col(f"`{v}`").cast("double").alias("x")) for v in covariates])
    long = df.where(F.col(treatment).isin(0, 1)).select(F.col(treatment).alias("arm"), F.col(weight).cast("double").alias("w"),
                                                        F.inline(values))
    m = moments(long, "x", "w", "w", ["variable", "arm"])
    sd = F.sqrt(F.try_divide(F.col("sxx"), F.when(F.col("w") > F.col("my"), F.col("w") - F.col("my"))))
    arm = [m.groupBy("variable").agg(*[F.first(F.when(F.col("arm") == a, x), ignorenulls=True).alias(f"{n}_{name}")
                                       for a, n in ((1, "treated"), (0, "control"))
                                       for name, x in (("mean", F.col("mx")), ("sd", sd), ("ess", F.try_divide("w", "my")))])][0]
    smd = F.when(F.col("treated_sd") > 0, (F.col("treated_mean") - F.col("control_mean")) / F.col("treated_sd")).otherwise(F.lit(0.0))
    return arm.select("variable", "treated_mean", "control_mean", smd.alias("smd"), "treated_sd", "control_sd", "treated_ess", "control_ess")


def balance_summary(bal: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Mean |SMD|, max |SMD| and the number of covariates with |SMD| > threshold."""
    a = F.abs(F.col("smd"))
    return bal.agg(F.avg(a).alias("mean_abs_smd"), F.max(a).alias("max_abs_smd"),
                   F.count_if(a > F.lit(threshold)).alias("n_above_threshold"))


def balance_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """C3 + D18 per covariate: |SMD| before, after and the improvement, most imbalanced first."""
    b = before.select("variable", F.abs("smd").alias("abs_smd_before"))
    a = after.select("variable", F.abs("smd").alias("abs_smd_after"))
    return (b.join(a, "variable", "inner")
            .withColumn("improvement", F.col("abs_smd_before") - F.col("abs_smd_after"))
            .orderBy(F.desc("abs_smd_before"), "variable"))


def balance_improvement(before: DataFrame, after: DataFrame) -> DataFrame:
    """D18 overall: mean |SMD| before and after over the covariates present in both, and the gain."""
    cmp = balance_compare(before, after)
    return cmp.agg(F.avg("abs_smd_before").alias("overall_before"), F.avg("abs_smd_after").alias("overall_after")) \
        .withColumn("improvement", F.col("overall_before") - F.col("overall_after"))


def sample_sizes(stages: dict, treatment: str) -> DataFrame:
    """Rows per arm for each named stage (e.g. before / after matching)."""
    out = None
    for name, frame in stages.items():
        part = frame.groupBy(treatment).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("stage"), F.col(treatment).alias("treated"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def top_imbalanced(bal: DataFrame, n: int = 10) -> DataFrame:
    """the ``n`` covariates with the largest |SMD| (a top-k report)."""
    return bal.withColumn("abs_smd", F.abs("smd")).orderBy(F.desc("abs_smd"), "variable").limit(n)
