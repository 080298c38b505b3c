"""Binning operators that need whole-column extremes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.operators.scaling import column_extremes
from equipoise.operators.joins import join_bounded


def width_bins(df: DataFrame, col: str, width: float = 60.0, out: str = "dose_bin",
               max_value: float | None = None) -> DataFrame:
    """Left-closed bins of fixed ``width`` from 0 up to the column maximum.

    Edges are 0, w, 2w, ... below max + w (so a maximum that is a multiple of
    ``w`` falls outside every bin, Q9); labels are ``'lo-hi'`` with hi = lo + w - 1
    in one-decimal float text.  When the maximum is not > 0 every row is
    labelled ``'0-59'`` as in the reference.  Adds ``out`` and ``out + '_start'``.
    ``max_value`` passes a maximum the caller has already measured.
    """
    mx = max_value if max_value is not None else column_extremes(df, [col])[col][1]
    if mx is None or mx <= 0:
        return df.withColumn(out, F.lit(f"0-{int(width) - 1}")).withColumn(out + "_start", F.lit(0.0))
    n_edges = math.ceil((mx + width) / width)  # len(arange(0, mx + w, w))
    last_edge = float((n_edges - 1) * width)
    x = F.col(col).cast("double")
    start = F.when((x >= 0) & (x < F.lit(last_edge)), F.floor(x / F.lit(float(width))) * F.lit(float(width)))
    label = F.format_string("%.1f-%.1f", start, start + F.lit(float(width) - 1.0))
    return df.withColumn(out + "_start", start.cast("double")).withColumn(out, F.when(start.isNotNull(), label))


def equal_width_edges(mn: float, mx: float, k: int) -> list[float]:
    """Edges of ``pd.cut(x, bins=k)``: linspace(min, max), first edge lowered by 0.1% of the range."""
    if mn == mx:
        mn = mn - (0.001 * abs(mn) if mn != 0 else 0.001)
        mx = mx + (0.001 * abs(mx) if mx != 0 else 0.001)
        step = (mx - mn) / k
        return [i * step + mn for i in range(k)] + [mx]
    step = (mx - mn) / k
    edges = [i * step + mn for i in range(k)] + [mx]
    edges[0] -= (mx - mn) * 0.001
    return edges


def equal_width_bins(df: DataFrame, col: str, labels: Sequence[str], out: str) -> DataFrame:
    """k = len(labels) right-closed equal-width bins over the column's min..max."""
    mn, mx = column_extremes(df, [col])[col]
    if mn is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    edges = equal_width_edges(float(mn), float(mx), len(labels))
    x = F.col(col)
    expr = None
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        cond = (x > F.lit(lo)) & (x <= F.lit(hi))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return df.withColumn(out, expr)


def histogram(df: DataFrame, col: str, bins: int, group: str | None = None) -> DataFrame:
    """Counts in ``bins`` equal bins over min..max (per ``group``: its own min..max, as in L1).

    The last bin is closed; empty bins are reported with count 0.  Returns
    (group?, bin, bin_lo, bin_hi, count).
    """
    data = df.where(F.col(col).isNotNull())
    if group is None:  # one global group: use a per-row constant that Catalyst cannot fold into a cross join
        data = data.withColumn("_g", F.when(F.col(col).isNotNull(), F.lit(0)))
    keys = [group or "_g"]
    stats = data.groupBy(*keys).agg(F.min(col).cast("double").alias("_mn"), F.max(col).cast("double").alias("_mx"))
    # numpy widens a zero range by 0.5 on both sides
    stats = stats.select(
        *keys,
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("_mn"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("_mx"),
    ).withColumn("_step", (F.col("_mx") - F.col("_mn")) / F.lit(float(bins)))

    def edge(i):
        return F.when(i >= bins, F.col("_mx")).otherwise(i * F.col("_step") + F.col("_mn"))

    x = F.col(col).cast("double")
    j = join_bounded(data.select(*keys, x.alias("_x")), stats, keys, "inner", known_rows=1 if group is None else None)
    idx = F.floor((F.col("_x") - F.col("_mn")) / (F.col("_mx") - F.col("_mn")) * F.lit(bins)).cast("int")
    idx = F.least(idx, F.lit(bins - 1))
    j = j.withColumn("_i", idx)
    j = j.withColumn("_i", F.when(F.col("_x") < edge(F.col("_i")), F.col("_i") - 1).otherwise(F.col("_i")))
    j = j.withColumn("_i", F.when((F.col("_x") >= edge(F.col("_i") + 1)) & (F.col("_i") != bins - 1),
                                  F.col("_i") + 1).otherwise(F.col("_i")))
    counts = j.groupBy(*keys, "_i").agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(*keys, "_mn", "_mx", "_step", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_i"))
    res = grid.join(counts, [*keys, "_i"], "left")
    return res.select(
        *([group] if group else []), F.col("_i").alias("bin"), edge(F.col("_i")).alias("bin_lo"), edge(F.col("_i") + 1).alias("bin_hi"),
        F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))
